"""Helpers that several of the operators share."""

from __future__ import annotations

import gc
import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsrisk.session import shared_dir

#: A word, for functions that take Java or Python patterns.
WORD = r"[^\x20\x09-\x0D]+"

#: Lower-cases A-Z and leaves every other byte, so UTF-8 stays UTF-8.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a text in UTF-8. `split` without arguments breaks bytes at exactly x20 and x09-x0D."""
    return text.translate(LOWER).split() if text else []


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The values of a string column as UTF-8, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of `column`; a longer text is a slice of its own."""
    for batch in batches:
        sizes = np.array([len(x) if x is not None else 0 for x in binary(batch.column(column))], dtype=np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def kept(df: DataFrame, keep: Sequence[str]) -> tuple[list[Column], list[str], list[T.StructField], list[Column]]:
    """Columns to carry through a Python step under names that clash with none.

    Their selection, the names, the fields of the step's schema, and the selection that gives the own names back.
    """
    names = [f"keep_{i}" for i in range(len(keep))]
    fields = [T.StructField(n, df.schema[c].dataType) for c, n in zip(keep, names)]
    quoted = ["`" + c.replace("`", "``") + "`" for c in keep]
    return (
        [F.col(q).alias(n) for q, n in zip(quoted, names)], names, fields, [F.col(n).alias(c) for c, n in zip(keep, names)],
    )


def whole_id(df: DataFrame, name: str) -> Column:
    """An id column: whole numbers as long, any other type as it is."""
    kind = df.schema[name].dataType
    return F.col(name).cast("long").alias(name) if isinstance(kind, T.IntegralType) else F.col(name)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


_shipped: set[str] = set()


def ship(df: DataFrame) -> None:
    """Give the executors this package, once in an application; it goes through the shared folder."""
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    package = Path(__file__).resolve().parents[1]
    if application in _shipped or not package.is_dir():  # from an archive it was shipped with the job
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tsrisk/package-{uuid.uuid4().hex}.zip")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(target)
    stream.write(data.getvalue())
    stream.close()
    system.deleteOnExit(target)
    spark.sparkContext.addPyFile(system.makeQualified(target).toString())
    _shipped.add(application)


def release(df: DataFrame) -> None:
    """Let Spark's cleaner take the shuffle files of steps whose results are staged; it waits for a collection on the driver."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
