"""Quoted fields with line breaks, read by many splits of one file."""

import csv
import random
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tsrisk.sources import delimited, records


@contextmanager
def splits_of(spark, size):
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def field(rng):
    kind = rng.random()
    if kind < 0.5:
        return rng.choice(["", "x", "plain words", "5'", "é"])
    parts = rng.choices(["a", "\n", "\n\n", '"', ",", ', "q",', "line of words", "é\n"], k=rng.randint(1, 12))
    return "".join(parts)


def write(path, rows, sep=","):
    with path.open("w", newline="") as out:
        writer = csv.writer(out, delimiter=sep, lineterminator="\n")
        writer.writerow(["ID", "Note", "Last"])
        writer.writerows(rows)


def got(raw):
    return sorted((r["ID"], r["Note"] or "", r["Last"] or "") for r in delimited.usable_rows(raw).collect())


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_same_rows_as_a_plain_reader_whatever_the_splits(spark, tmp_path, size):
    expected = []
    for name, seed in (("a", size), ("b", size + 1)):
        rng = random.Random(seed)
        rows = [(f"{name}{i}", field(rng), field(rng)) for i in range(80)]
        write(tmp_path / f"{name}.csv", rows)
        expected += rows
    with splits_of(spark, size):
        raw = delimited.read_raw(spark, f"{tmp_path}/*.csv")
        assert got(raw) == sorted(expected)
        assert delimited.quarantined_rows(raw).count() == 0
        if size < 100:
            assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10


@pytest.mark.parametrize("sep", [",", "\t", "|", ";"])
def test_every_separator(spark, tmp_path, sep):
    rows = [("1", f'two{sep}\nlines "quoted"', "z"), ("2", "x", f"{sep}\n{sep}"), ("3", 'say ""\n', "")]
    write(tmp_path / "a.csv", rows, sep)
    with splits_of(spark, 20):
        assert got(delimited.read_raw(spark, str(tmp_path / "a.csv"), sep=sep)) == rows


def test_same_as_the_reader_of_whole_files(spark, tmp_path):
    rng = random.Random(11)
    rows = [(str(i), field(rng).strip("\n") or "x", "e") for i in range(100)]
    write(tmp_path / "a.csv", rows)
    with splits_of(spark, 200):
        ours = got(delimited.read_raw(spark, str(tmp_path / "a.csv")))
    assert ours == got(delimited.read_raw(spark, str(tmp_path / "a.csv"), multiline=True))


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_a_quote_that_never_closes_costs_its_own_line(spark, tmp_path, monkeypatch, size):
    """The line is set aside once its field is longer than a field may be; what follows is read, whatever the splits."""
    monkeypatch.setattr(records, "MAX_FIELD", 120)
    lines = ["ID,Note,Last"] + [f"{i},n{i},z" for i in range(20)] + ['20,"open,z'] + [f"{i},n{i},z" for i in range(21, 60)]
    lines += ['60,"two', 'lines",z', '61,"never'] + [f"{i},m,z" for i in range(62, 90)] + ['90,"at the end']
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    with splits_of(spark, size):
        raw = delimited.read_raw(spark, str(tmp_path / "a.csv"))
        ids = {int(r[0]) for r in got(raw)}
        aside = sorted(r["line"] for r in delimited.quarantined_rows(raw).collect())
    assert aside == ['20,"open,z', '61,"never', '90,"at the end']
    assert ids == set(range(90)) - {20, 61}


def test_files_without_such_fields_are_passed_on(spark, tmp_path):
    write(tmp_path / "a.csv", [(str(i), 'a "b", c', "5'") for i in range(50)])
    with splits_of(spark, 100):
        text = records.records(spark, str(tmp_path / "a.csv"))
        assert "MapInArrow" not in text._jdf.queryExecution().toString()
        assert text.count() == 51


def test_states_of_lines(spark):
    cases = {
        "a,b": (False, True), "": (False, True), 'a,"b"': (False, False), 'a,"b': (True, False), 'b",c': (False, False),
        'b",c,"d': (False, True), '5" pipe,b': (False, False), 'a,5" x,"': (True, True), '""': (False, True), 'a,"x""': (True, True),
        'a,"x"",b': (True, True), '"a" ,"b" c,d': (False, False),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "line string")
    opens, stays = records._states(F.col("line"), ",")
    found = {r[0]: (r[1], r[2]) for r in rows.select("line", opens, stays).collect()}
    plain = {}
    for line in cases:
        ends = []
        for inside in (False, True):
            at_start, i = not inside, 0
            while i < len(line):
                if inside:
                    if line[i] == '"':
                        if line[i + 1 : i + 2] == '"':
                            i += 1
                        else:
                            inside = False
                elif line[i] == '"' and at_start:
                    inside = True
                at_start = not inside and line[i] == ","
                i += 1
            ends.append(inside)
        plain[line] = tuple(ends)
    assert found == plain


def test_long_lines_do_not_recurse(spark):
    line = ",".join(['"a ""b"" c"'] * 100_000) + ',"open ' + '""' * 100_000
    opens, stays = records._states(F.col("line"), ",")
    assert tuple(spark.createDataFrame([(line,), ('""' * 100_000,)], "line string").select(opens, stays).first()) == (True, True)


def test_cut_by_hand():
    opens = np.array([0, 1, 0, 0, 1, 0], bool)
    stays = np.array([1, 0, 1, 0, 0, 1], bool)
    sizes = np.full(6, 10)
    assert records.cut(opens, stays, sizes, 100) == ([(1, 3)], 4)
    assert records.cut(opens, stays, sizes, 15) == ([], 4)
    scanner = records.Scanner(100)
    lines = pa.array(list("abcdef"), pa.string())
    whole = scanner.feed(lines.slice(0, 3), opens[:3], stays[:3]).to_pylist() + scanner.feed(lines.slice(3), opens[3:], stays[3:]).to_pylist()
    assert whole == ["a", "b\nc\nd"] and scanner.give_up().to_pylist() == ["e", "f"]
