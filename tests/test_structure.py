"""Delimited text and JSON in splits: what is read, and what is refused by its line."""

from __future__ import annotations

import csv
import io
import random

import pytest

from assayer import core, sources
from assayer.sources import load, structure


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that small files have many."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def put(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(path)


def read(spark, path, **options):
    return sources.load_table(spark, path, load.Options(**options)).df


def texts(rows):
    return sorted(tuple(None if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_quoted_records_over_many_splits(spark, tmp_path, small_splits, seed):
    r = random.Random(seed)
    bits = ["a", "b c", 'say ""so""', "line\nfeed", "x,y", "é", "\n\n", "long " * r.choice([1, 90]), ""]
    rows = [[f"k{i}", *("".join(r.choice(bits).replace('""', '"') for _ in range(r.randint(0, 4))) for _ in range(2))] for i in range(120)]
    out = io.StringIO()
    csv.writer(out, lineterminator=r.choice(["\n", "\r\n"])).writerows([["k", "one", "two"], *rows])
    path = put(tmp_path, "t.csv", out.getvalue())
    lines = structure.lines_of(spark, path)
    assert lines.select("start").distinct().count() > 5
    got = [tuple(x) for x in read(spark, path).collect()]
    want = [tuple(v if v not in load.MISSING else None for v in x) for x in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_header_of_several_splits(spark, tmp_path, small_splits):
    name = "wide\n" * 120
    path = put(tmp_path, "t.csv", f'"{name}",b\n1,2\n3,4\n')
    df = read(spark, path)
    assert df.columns == [name, "b"]
    assert texts(df.collect()) == [("1", "2"), ("3", "4")]


@pytest.mark.parametrize(
    ("text", "error", "line"),
    [
        ('a,b\n1,2\n"3,4\n5,6\n', core.MalformedInputError, 3),
        ('a,b\n1,2\n"3"x,4\n', core.MalformedInputError, 3),
        ("a,b\n1,2\n\n3\n", core.MalformedInputError, 4),
        ('a,b\n"1\n\n",2\n3,4,5\n', core.MalformedInputError, 5),
        ('a,b\n1,"x\ny",3\n', core.MalformedInputError, 2),
        ("a,a,b\n1,2,3\n", core.DuplicateHeadersError, None),
        ("a,b\n", core.EmptyDataError, None),
        ("", core.EmptyDataError, None),
        (" , \n,\n", core.EmptyDataError, None),
        (b"a,b\n1,\xff\n", core.EncodingError, None),
        (b"a,b\n1,\x00\n", core.EncodingError, None),
    ],
)
def test_refusals_of_delimited_text(spark, tmp_path, text, error, line):
    with pytest.raises(error) as caught:
        read(spark, put(tmp_path, "t.csv", text), delimiter=",")
    assert getattr(caught.value, "line", None) == line


@pytest.mark.parametrize("at", [3, 150, 399])
def test_lines_are_counted_over_splits(spark, tmp_path, small_splits, at):
    rows = ["a,b", *[f"{i},value {i}" for i in range(400)]]
    rows[at] += ",more"
    with pytest.raises(core.MalformedInputError) as caught:
        read(spark, put(tmp_path, "t.csv", "\n".join(rows) + "\n"))
    assert caught.value.line == at + 1
    rows[at] = '"open,x'
    with pytest.raises(core.MalformedInputError) as caught:
        read(spark, put(tmp_path, "u.csv", "\n".join(rows) + "\n"), delimiter=",")
    assert caught.value.line == at + 1


def test_encodings_separators_and_plain_tables(spark, tmp_path):
    assert texts(read(spark, put(tmp_path, "a.tsv", "x\ty\n1\tz\n")).collect()) == [("1", "z")]
    assert read(spark, put(tmp_path, "b.csv", "﻿x;y\n1;2\n"), encoding="utf-8-sig").columns == ["x", "y"]
    assert texts(read(spark, put(tmp_path, "c.csv", "x,y\né,1\n", "latin-1"), encoding="latin-1").collect()) == [("é", "1")]
    assert texts(read(spark, put(tmp_path, "d.csv", "1,2\n3,4\n"), header=False).collect()) == [("1", "2"), ("3", "4")]
    assert texts(read(spark, put(tmp_path, "e.csv", 'x,y\n"a\nb",1\n', "latin-1"), encoding="latin-1").collect()) == [("a\nb", "1")]
    df = read(spark, put(tmp_path, "f.csv", "x,y\n1,2.5\n2,\n\n3,nan\n"))
    assert (df.dtypes, df.count()) == ([("x", "bigint"), ("y", "double")], 3)


def test_files_of_one_table_have_one_header(spark, tmp_path):
    for i, head in enumerate(["a,b", "a,b"]):
        put(tmp_path, f"{i}.csv", f"{head}\n{i},x\n")
    assert texts(read(spark, f"{tmp_path}/*.csv", delimiter=",").collect()) == [("0", "x"), ("1", "x")]
    put(tmp_path, "2.csv", "b,a\n1,2\n")
    with pytest.raises(core.SchemaError):
        read(spark, f"{tmp_path}/*.csv", delimiter=",")


# ---- JSON ----


@pytest.mark.parametrize(
    ("text", "line", "says"),
    [
        ('{"a": 1}\nnot json\n{"a": 2}\n', 2, "no JSON"),
        ('{"a": 1}\n\n[1, 2]\n', 3, "is an array, not an object"),
        ('{"a": 1, "a": 2}\n', 1, "repeats the key 'a'"),
        ('{"a": 1}\n{"a": NaN}\n', 2, "NaN"),
        ('{"a": -Infinity}\n', 1, "-Infinity"),
        ('{"a": {"x": 1}}\n', 1, "an object under 'a'"),
        ('{"a": [1]}\n', 1, "an array under 'a'"),
        (b'{"a": "\x00"}\n', 1, "NUL"),
        (b'{"a": "\xff"}\n', 1, "decoded"),
    ],
)
def test_refusals_of_json(spark, tmp_path, text, line, says):
    with pytest.raises(core.MalformedInputError, match=says) as caught:
        read(spark, put(tmp_path, "t.jsonl", text))
    assert caught.value.line == line
    whole = b"[" + b",".join(x for x in (text if isinstance(text, bytes) else text.encode()).split(b"\n") if x) + b"]"
    with pytest.raises(core.MalformedInputError, match=says.replace("is an array", "is an array")):
        read(spark, put(tmp_path, "t.json", whole))


def test_json_refusals_do_not_show_content(spark, tmp_path):
    with pytest.raises(core.MalformedInputError, match="line 1, column") as caught:
        read(spark, put(tmp_path, "t.json", '[{"a": 1}, {"do_not_leak": ]]'))
    assert "do_not_leak" not in str(caught.value)


def test_json_lines_are_counted_over_splits(spark, tmp_path, small_splits):
    rows = [f'{{"a": {i}, "b": "x{i}"}}' for i in range(300)]
    path = put(tmp_path, "t.jsonl", "\n".join(rows))
    assert read(spark, path).count() == 300
    rows[211] = '{"a": 1, "b": "x", "b": "y"}'
    with pytest.raises(core.MalformedInputError) as caught:
        read(spark, put(tmp_path, "u.jsonl", "\n".join(rows)))
    assert caught.value.line == 212


def test_json_kinds_and_limits(spark, tmp_path):
    rows = '{"n": 1, "x": 1, "ok": true, "t": "a", "m": 1, "big": 99999999999999999999}\n{"x": 0.5, "ok": null, "m": "b", "late": null}\n'
    df = read(spark, put(tmp_path, "t.jsonl", rows))
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "ok": "boolean", "t": "string", "m": "string", "big": "decimal(38,0)", "late": "string"}
    assert [r["m"] for r in df.orderBy("x").collect()] == ["b", "1"]
    two = '[{"a": 1, "b": "x", "ok": true}, {"a": 2, "b": null, "ok": false}]'
    lines = "\n".join(two[1:-1].replace("}, {", "}\n{").split("\n"))
    for path in (put(tmp_path, "u.json", two), put(tmp_path, "u.jsonl", lines)):
        for name, exact in [("max_keys_per_record", 3), ("max_record_chars", 10), ("max_rows", 2), ("max_columns", 3), ("max_cells", 6)]:
            sources.load_table(spark, path, limits=load.Limits(**{name: exact}))
            with pytest.raises(core.LimitExceededError) as caught:
                sources.load_table(spark, path, limits=load.Limits(**{name: exact - 1}))
            assert caught.value.limit == name
    for name in ("v.jsonl", "v.json"):
        with pytest.raises(core.EmptyDataError):
            read(spark, put(tmp_path, name, "\n\n"))
