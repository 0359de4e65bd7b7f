"""Delimited text: tolerant scan, previews and delimiter checks."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tsrisk.names import CORRUPT, raw_schema
from tsrisk.sources.records import records

# --- fixed values: the delimiters that are tried ---------------------------
DELIMITERS = (",", "\t", "|", ";")

# No group in the pattern: Java would recurse once for each repetition of it.
_QUOTED = r'"[^"]*"'


def _options(sep: str) -> dict[str, str]:
    return {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def headers(spark: SparkSession, path: str, sep: str = ",") -> dict[str, list[str]]:
    """Each distinct header line with the files it leads; one line of each file is read, in parallel, on the driver."""
    files = [r.path for r in spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0").collect()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def first_line(file: str) -> str:
        location = jvm.org.apache.hadoop.fs.Path(file)
        stream = location.getFileSystem(conf).open(location)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(location)
        plain = codec.createInputStream(stream) if codec else stream
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))
        try:
            return (lines.readLine() or "").removeprefix("\ufeff")
        finally:
            lines.close()

    found: dict[str, list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for file, line in zip(files, pool.map(first_line, files)):
            found.setdefault(line, []).append(file)
    return found


def _names(header: str, sep: str) -> list[str]:
    return next(csv.reader([header], delimiter=sep), [])


def read_raw(spark: SparkSession, path: str, columns=None, sep: str = ",", multiline: bool | None = None) -> DataFrame:
    """Scan delimited text with a header; every column is text.

    Files are read by their own header, so their columns may stand in any
    order; a header with other names is an error. `columns` renames the first
    header's columns by position. Short rows are padded with NULL. A row that
    does not fit, or whose quotes do not close, keeps its text in
    `_corrupt_record` for `usable_rows` and `quarantined_rows` to tell apart.
    Quoted fields may hold line breaks; `records` finds them split by split in a
    pass of its own. `multiline=False` spares that pass and takes each line for
    a row; `True` leaves it to Spark's reader, which makes a file one task.
    """
    by_header = headers(spark, path, sep)
    if not by_header:
        if columns is None:
            raise ValueError(f"no header in {path}")
        return spark.createDataFrame([], raw_schema(columns))
    first = _names(next(iter(sorted(by_header))), sep)
    parts = []
    for header, files in sorted(by_header.items()):
        names = _names(header, sep)
        if sorted(names) != sorted(first):
            raise ValueError(f"header {names} of {files[0]} does not match {first}")
        schema = raw_schema(names)
        if multiline:
            # With pruned columns the parser would not notice rows that do not fit.
            reader = spark.read.options(**_options(sep), header=True, multiLine=True, columnPruning=False)
            rows = reader.schema(schema).csv(files)
        else:
            text = records(spark, files, sep) if multiline is None else spark.read.text(files)
            lines = text.where((F.trim("value") != "") & (F.ltrim("value", F.lit("\ufeff")) != header))
            rows = lines.select(F.from_csv("value", _ddl(schema), _options(sep)).alias("row"), "value")
            broken = F.coalesce(F.col(f"row.{CORRUPT}"), F.when(_quotes(F.col("value")) % 2 == 1, F.col("value")))
            rows = rows.select(*[F.col(f"row.`{n}`") for n in names], broken.alias(CORRUPT))
        parts.append(rows.select(*[f"`{n}`" for n in first], CORRUPT))
    whole = reduce(DataFrame.unionByName, parts)
    return whole.toDF(*columns, CORRUPT) if columns is not None else whole


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` string" for f in schema)


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _unusable(raw: DataFrame, sep: str) -> Column:
    """Has the kept line more fields than the header, or an open quote? Separators inside quotes do not count."""
    bare = F.regexp_replace(F.col(CORRUPT), _QUOTED, "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    # The reader refuses a plan that needs the kept line alone, so one data column stays in use.
    reads_data = F.coalesce(F.length(F.col(f"`{raw.columns[0]}`")), F.lit(0)) >= 0
    bad = (fields > len(raw.columns) - 1) | (_quotes(F.col(CORRUPT)) % 2 == 1)
    return F.coalesce(bad, F.lit(False)) & reads_data


def usable_rows(raw: DataFrame, sep: str = ",") -> DataFrame:
    """Whole rows and short, padded rows."""
    return raw.where(~_unusable(raw, sep)).drop(CORRUPT)


def quarantined_rows(raw: DataFrame, sep: str = ",") -> DataFrame:
    """The records with more fields than the header, and those with an open quote."""
    return raw.where(_unusable(raw, sep)).select(F.col(CORRUPT).alias("line"))


def preview_lines(spark: SparkSession, path: str, n: int = 5, width: int = 1000) -> DataFrame:
    """The first `n` lines, by file name and place in the file, cut to `width` characters."""
    lines = spark.read.text(path).select(
        F.substring("value", 1, width).alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
    )
    return lines.orderBy("file", "block", "place").limit(n).select("line")


def first_lines(df: DataFrame, text: str, order: str, n: int = 5, width: int = 1000) -> DataFrame:
    """The first `n` lines of texts in a column, by `order` and place in the text, cut to `width` characters.

    A text has at least one line, so only the first `n` texts are split.
    """
    lines = df.where(F.col(text).isNotNull()).orderBy(order).limit(n).select(order, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return lines.orderBy(order, "at").limit(n).select(F.substring("line", 1, width).alias("line"))


def file_profile(spark: SparkSession, path: str) -> DataFrame:
    """Path and size of each file; the content is not read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    return files.withColumn("gigabytes", F.round(F.col("bytes") / F.lit(1024.0**3), 2))


def total_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files under `path`, from their listing."""
    return file_profile(spark, path).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def _occurrences(text: Column, delimiter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(delimiter), F.lit("")))


def delimiter_profile(df: DataFrame, text: str, order: str) -> DataFrame:
    """Occurrences of each delimiter in all text, and the columns it would give the first line."""
    head = F.trim(F.split(F.col(text), "\n")[0])
    measures = []
    for i, d in enumerate(DELIMITERS):
        measures.append(F.sum(_occurrences(F.col(text), d)).alias(f"n{i}"))
        measures.append(F.min_by(_occurrences(head, d) + 1, order).alias(f"c{i}"))
    rows = [
        F.struct(
            F.lit(d).alias("delimiter"),
            F.col(f"n{i}").alias("occurrences"),
            F.col(f"c{i}").cast("bigint").alias("first_line_columns"),
        )
        for i, d in enumerate(DELIMITERS)
    ]
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def delimiter_consistency(df: DataFrame, text: str) -> DataFrame:
    """Per delimiter the most common count per line (zero left out) and the share of lines that have it."""
    lines = df.select(F.explode(F.split(F.col(text), "\n")).alias("line")).where(F.trim("line") != "")
    found = [F.struct(F.lit(d).alias("delimiter"), _occurrences(F.col("line"), d).alias("per_line")) for d in DELIMITERS]
    spread = lines.select(F.inline(F.array(*found))).groupBy("delimiter", "per_line").agg(
        F.count(F.lit(1)).alias("lines")
    )
    rated = spread.groupBy("delimiter").agg(
        F.sum("lines").alias("all_lines"),
        F.max(F.when(F.col("per_line") > 0, F.struct("lines", "per_line"))).alias("mode"),
    )
    return rated.select(
        "delimiter",
        F.col("mode.per_line").cast("bigint").alias("per_line"),
        F.round(F.coalesce(F.col("mode.lines"), F.lit(0)) / F.col("all_lines"), 6).alias("line_share"),
    )


def detect_delimiter(df: DataFrame, text: str) -> DataFrame:
    """The delimiter with the steadiest count per line; no row when none occurs."""
    rated = delimiter_consistency(df, text).where(F.col("per_line").isNotNull())
    return rated.orderBy(F.desc("line_share"), F.desc("per_line"), "delimiter").limit(1)


def describe(df: DataFrame) -> DataFrame:
    """Column names and types as a table."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, column_type string")


def describe_values(df: DataFrame) -> DataFrame:
    """Each column with its type, values, missing values and distinct values, in one pass."""
    kinds = dict(df.dtypes)
    rows = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("column_type"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in df.columns
    ])))
    return rows.groupBy("column_name", "column_type").agg(
        F.count("value").alias("n_values"), F.sum(F.col("value").isNull().cast("bigint")).alias("n_missing"),
        F.countDistinct("value").alias("n_distinct"),
    )
