"""CSV files with quoted line breaks against Python's reader, in splits of a few bytes."""

import csv
import io
import random

import pytest

from millrace.sources import files
from millrace.sources.records import ends_inside, records


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "211", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("line", "inside", "want"), [("a,b", False, False), ("a,b", True, True), ('"a', False, True), ('a"', True, False), ('x,"y ""z', False, True), ('5" pipe, 6" pipe', False, False), ('"a"b"c,"d', False, True), ('""', False, False), ('""', True, True), ('"', True, False), ('a"",b', True, True), ('a","b', True, True)])
def test_states(line, inside, want):
    assert ends_inside(line, inside, ",") is want


def python_rows(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def test_records_in_small_splits(spark, tmp_path, small_splits):
    r = random.Random(2)
    cell = lambda: r.choice(["plain", "", "a, b", "two\nlines", 'say ""x""', "\n\n", 'tail""', "long " * r.randint(1, 60), "three\n,\"\"\n lines"])
    texts = []
    for k in range(3):
        rows = [["id", "note", "more"], *([str(i), cell(), cell()] for i in range(40))]
        texts.append("\n".join(",".join(f'"{c}"' if any(x in c for x in ',"\n') or r.random() < 0.2 else c for c in row) for row in rows) + ("\n" if k else ""))
        (tmp_path / f"f{k}.csv").write_text(texts[-1])
    got = {}
    for x in records(spark, f"file://{tmp_path}").collect():
        got.setdefault(x.path.rsplit("/", 1)[-1], []).append((x.line, x.value))
    for k, text in enumerate(texts):
        assert [next(csv.reader(io.StringIO(v, newline=""))) for _, v in sorted(got[f"f{k}.csv"])] == python_rows(text)
    assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 25
    table = files.read_csv(spark, f"file://{tmp_path}/f1.csv")
    want = sorted((i, a or None, b or None) for i, a, b in python_rows(texts[1])[1:])
    assert sorted((x.id, x.note or None, x.more or None) for x in table.collect()) == want


def test_the_quoted_line_break(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfId;Text\r\n1;"line one\r\nline two"\r\n\r\n2;"a ""b"" ; c"\r\n3;5" pipe\r\n4;x;y\r\n5\r\n')
    rows = sorted(map(tuple, files.read_csv(spark, f"file://{tmp_path}/a.csv").collect()))
    assert rows == [("1", "line one\r\nline two"), ("2", 'a "b" ; c'), ("3", '5" pipe'), ("5", None)]
    assert files.read_csv(spark, f"file://{tmp_path}/a.csv").columns == ["id", "text"]


def test_a_quote_that_stays_open_and_an_empty_file(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n3,z\n')
    (tmp_path / "none.csv").write_text("")
    got = [(r.line, r.value) for r in records(spark, f"file://{tmp_path}").orderBy("line").collect()]
    assert got == [(0, "a,b"), (1, '1,"x\n2,y\n3,z')]
