"""Structural scans of text files in splits: quoted records and strict JSON lines.

A file is read in splits, and what a split means may depend on what lies before it: whether
it starts inside a quoted field. Each split is therefore scanned under both assumptions, and
one row a split goes to the driver, where a pass over the rows in order picks the true ones.
Line numbers come from the same pass. Tasks see bytes (as Latin-1, one character each) and
decode them strictly, so that an undecodable byte is found and not replaced.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer import core

CODECS = {"utf-8": "utf-8", "utf-8-sig": "utf-8", "latin-1": "latin-1", "cp1256": "cp1256"}
NONE = -1
NESTED = "nested"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``value`` (the bytes of a line, without the line feed), ``file`` and ``start`` of its split. A split's lines lie together, in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """The batches' lines as Latin-1, in pieces of one split each; a split may come in several pieces."""
    for batch in batches:
        raw, files, starts = (batch.column(i).to_pylist() for i in range(3))
        values = [v.decode("latin-1") for v in raw]
        at = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or (files[i], starts[i]) != (files[at], starts[at]):
                yield files[at], starts[at], values[at:i]
                at = i


def walk(line: str, inside: bool, delimiter: str) -> tuple[bool, int, bool]:
    """One line of quoted fields: whether it ends inside a quoted field, its delimiters, and whether the quoting is well-formed."""
    at, n, found = 0, len(line), 0
    while True:
        if inside:
            q = line.find('"', at)
            if q < 0:
                return True, found, True
            at = q + 1
            if at < n and line[at] == '"':
                at += 1
                continue
            inside = False
            if at == n or line[at:] == "\r":
                return False, found, True
            if line[at] != delimiter:
                return False, found, False
            found += 1
            at += 1
        if at < n and line[at] == '"':
            inside, at = True, at + 1
            continue
        next_ = line.find(delimiter, at)
        if next_ < 0:
            return False, found, True
        found, at = found + 1, next_ + 1


@dataclass
class Outline:
    """What one split holds if it starts outside (or inside) a quoted field. Lines count from 0 in the split."""

    inside: bool
    lines: int = 0
    records: int = 0  # that end here
    filled: bool = False  # some field is not blank
    spans: bool = False  # some record has several lines
    bad: int = NONE  # line of the first malformed quoting
    odd: int = NONE  # line of the first undecodable or NUL byte
    head: int = NONE  # delimiters before the end of the record that was open at the start
    head_line: int = NONE
    tail: int = 0  # delimiters of the record that is open at the end
    tail_line: int = 0
    widths: list[tuple[int, int]] = field(default_factory=list)  # the first two different widths of whole records, and their lines
    first: list[str] = field(default_factory=list)  # lines of the first record

    def put(self, line: str, delimiter: str, start_inside: bool) -> None:
        number = self.lines
        self.lines += 1
        fresh = not self.inside
        if fresh and line in ("", "\r"):
            return
        if fresh:
            self.tail, self.tail_line = 0, number
        if '"' in line:
            self.inside, found, good = walk(line, self.inside, delimiter)
            if not good and self.bad == NONE:
                self.bad = number
        else:
            found = 0 if self.inside else line.count(delimiter)
        self.filled |= bool(line.strip().strip(delimiter + '" \r'))
        self.spans |= self.inside
        self.tail += found
        opening = self.records == 0 and start_inside and self.head == NONE
        if self.records == 0 and not start_inside:
            self.first.append(line)
        if self.inside:
            return
        if opening:
            self.head, self.head_line = self.tail, number
        else:
            width = self.tail + 1
            if len(self.widths) < 2 and all(w != width for w, _ in self.widths):
                self.widths.append((width, self.tail_line))
        self.records += 1


OUTLINE = (
    "file string, start long, assumed boolean, inside boolean, lines long, records long, filled boolean, spans boolean, bad long, odd long, "
    "head long, head_line long, tail long, tail_line long, widths array<long>, width_lines array<long>, first string"
)


def outlines(lines: DataFrame, delimiter: str, codec: str) -> DataFrame:
    """Two rows a split, one for each assumption about its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        pair: list[Outline] = []

        def put() -> pa.RecordBatch:
            rows = []
            for assumed, o in zip((False, True), pair, strict=True):
                first = "\n".join(o.first) if now[1] == 0 and not assumed and o.records else None
                rows.append((*now, assumed, o.inside, o.lines, o.records, o.filled, o.spans, o.bad, o.odd, o.head, o.head_line, o.tail, o.tail_line, [w for w, _ in o.widths], [x for _, x in o.widths], first))
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 6, *[pa.list_(pa.int64())] * 2, pa.string()]
            names = [part.split()[0] for part in OUTLINE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for file, start, values in splits(batches):
            if (file, start) != now:
                if now:
                    yield put()
                now, pair = (file, start), [Outline(False), Outline(True)]
            for line in values:
                odd = "\0" in line
                if not odd and not line.isascii() and codec != "latin-1":
                    try:
                        line.encode("latin-1").decode(codec)
                    except UnicodeDecodeError:
                        odd = True
                for assumed, o in zip((False, True), pair, strict=True):
                    if odd and o.odd == NONE:
                        o.odd = o.lines
                    if not (assumed and start == 0):
                        o.put(line, delimiter, assumed)
        if now:
            yield put()

    return lines.mapInArrow(run, OUTLINE)


@dataclass(frozen=True)
class Shape:
    """A table of delimited text that is well-formed."""

    names: list[str]
    records: int  # without headers
    spans: bool  # some record has several lines
    inside: frozenset[tuple[str, int]]  # splits that start inside a quoted field


def decoded(text: str, codec: str) -> str:
    return text.encode("latin-1").decode(codec)


def fields_of(record: str, delimiter: str) -> list[str]:
    return next(csv.reader([part + "\n" for part in record.removesuffix("\r").split("\n")], delimiter=delimiter, strict=True), [])


def check_delimited(spark: SparkSession, path: str, delimiter: str, encoding: str, header: bool) -> Shape:
    """The shape of delimited text, or a typed refusal that names the line.

    Refused are malformed and unclosed quoting, a record of another width than the first, undecodable and NUL
    bytes, a repeated header, files of different headers, and a table without values or rows. Blank lines are no records.
    """
    codec = CODECS[encoding]
    rows = outlines(lines_of(spark, path), delimiter, codec).collect()  # two a split
    if not rows:
        raise core.EmptyDataError(f"{path} holds no values")
    files: dict[str, dict[int, dict[bool, Any]]] = {}
    for r in rows:
        files.setdefault(r["file"], {}).setdefault(r["start"], {})[r["assumed"]] = r
    names: list[str] | None = None
    total, spans, filled, inside_at = 0, False, False, set()
    for file in sorted(files):
        inside, before, tail, tail_line, width, records = False, 0, 0, 0, None, 0
        say = file.rpartition("/")[2]
        for start in sorted(files[file]):
            r = files[file][start][inside]
            if inside:
                inside_at.add((file, start))
            if r["odd"] != NONE:
                raise core.EncodingError(f"{say}: line {before + r['odd'] + 1} holds a NUL byte or cannot be decoded as {encoding}")
            if r["bad"] != NONE:
                raise core.MalformedInputError(f"{say}: malformed quoting on line {before + r['bad'] + 1}", before + r["bad"] + 1)
            seen = []
            if inside and r["head"] != NONE:
                seen.append((tail + r["head"] + 1, tail_line))
            seen += [(w, before + x) for w, x in zip(r["widths"], r["width_lines"], strict=True)]
            for w, line in seen:
                width = width or w
                if w != width:
                    raise core.MalformedInputError(f"{say}: the record of line {line + 1} has {w} fields, the first one {width}", line + 1)
            if r["inside"]:
                whole = inside and r["head"] == NONE
                tail, tail_line = (tail + r["tail"], tail_line) if whole else (r["tail"], before + r["tail_line"])
            inside, before = r["inside"], before + r["lines"]
            records, spans, filled = records + r["records"], spans or r["spans"], filled or r["filled"]
        if inside:
            raise core.MalformedInputError(f"{say}: a quote that opens in the record of line {tail_line + 1} is never closed", tail_line + 1)
        if not records:
            continue
        first = first_record(files[file], spark, path, file, delimiter)
        own = fields_of(decoded(first, codec).lstrip("﻿"), delimiter)
        if not header:
            own = [f"_c{i}" for i in range(len(own))]
        if names is not None and own != names:
            raise core.SchemaError(f"{say}: its header differs from that of the files before it")
        names, total = own, total + records - header
    if names is None or not filled:
        raise core.EmptyDataError(f"{path} holds no values")
    lowered = [n.lower() for n in names]
    repeated = sorted({n for n in names if lowered.count(n.lower()) > 1})
    if header and repeated:
        raise core.DuplicateHeadersError(f"the header names {', '.join(repeated)} more than once")
    if total == 0:
        raise core.EmptyDataError(f"{path} has a header and no rows")
    return Shape(names, total, spans, frozenset(inside_at))


def first_record(of_file: dict[int, dict[bool, Any]], spark: SparkSession, path: str, file: str, delimiter: str) -> str:
    """The first record of a file; where it goes beyond the first split, its lines are read again."""
    first = of_file[0][False]["first"] if 0 in of_file else None
    if first is not None:
        return first
    kept: list[str] = []
    inside = False
    for r in lines_of(spark, path).where(F.col("file") == file).toLocalIterator():
        line = bytes(r["value"]).decode("latin-1")
        if not inside and line in ("", "\r"):
            continue
        kept.append(line)
        inside = walk(line, inside, delimiter)[0]
        if not inside:
            break
    return "\n".join(kept)


def records_of(spark: SparkSession, path: str, delimiter: str, encoding: str, header: bool, shape: Shape) -> DataFrame:
    """All records as text columns, for files in which records have several lines.

    Each split parses the records that lie in it. Only where a record crosses into the next split its
    pieces are put together, each such record in a group of its own. Empty fields are NULL.
    """
    codec, width, known = CODECS[encoding], len(shape.names), shape.inside
    cells = pa.list_(pa.string())

    def parsed(texts: list[str]) -> pa.Array:
        out = []
        for t in texts:
            values = fields_of(decoded(t, codec), delimiter)
            out.append([v if v != "" else None for v in values])
        return pa.array(out, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        held: list[str] = []
        inside = crossing = skip = False

        def batch_of(whole: list[str], pieces: list[tuple[str, int, bool, str]]) -> pa.RecordBatch:
            made = parsed(whole)
            empty = pa.array([None] * len(pieces), cells)
            put = lambda i, t: pa.array([None] * len(whole) + [p[i] for p in pieces], t)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([made, empty]), put(0, pa.string()), put(1, pa.int64()), put(2, pa.bool_()), put(3, pa.string())],
                names=["cells", "file", "start", "ends", "piece"],
            )

        for file, start, values in splits(batches):
            whole: list[str] = []
            pieces: list[tuple[str, int, bool, str]] = []
            if (file, start) != now:
                if now and held:
                    pieces.append((*now, False, "\n".join(held)))
                now, held = (file, start), []
                inside = crossing = now in known
                skip = header and start == 0
            for line in values:
                if not inside and line in ("", "\r"):
                    continue
                held.append(line)
                inside = walk(line, inside, delimiter)[0]
                if inside:
                    continue
                if crossing:
                    pieces.append((*now, True, "\n".join(held)))
                elif skip:
                    skip = False
                else:
                    whole.append("\n".join(held))
                held, crossing = [], False
            yield batch_of(whole, pieces)
        if now and held:
            yield batch_of([], [(*now, False, "\n".join(held))])

    found = lines_of(spark, path).mapInArrow(run, "cells array<string>, file string, start long, ends boolean, piece string")
    named = [F.col("cells")[i].alias(n) for i, n in enumerate(shape.names)]
    table = found.where("cells IS NOT NULL").select(*named)
    if not known:
        return table
    # The pieces of a record: what is open at the end of a split, whole splits, and the end in the last one.
    starts: dict[str, list[int]] = {}
    for file, start in sorted(known):
        starts.setdefault(file, []).append(start)
    order = Window.partitionBy("file").orderBy("start", F.col("ends").desc())
    pieces = found.where("piece IS NOT NULL")
    numbered = pieces.withColumn("record", F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = numbered.groupBy("file", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "piece"))), lambda s: s["piece"]), "\n").alias("text"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([parsed(batch.column(0).to_pylist())], names=["cells"])

    first = F.col("record") == 0 if header else F.lit(False)
    begins = spark.createDataFrame([(f, _opens_first(spark, path, f, delimiter)) for f in sorted(starts)], "file string, header_crosses boolean") if header else None
    if begins is not None:  # a header that crosses splits is no row
        joined = joined.join(F.broadcast(begins), "file").where(~(first & F.col("header_crosses")))
    return table.union(joined.select("text").mapInArrow(settle, "cells array<string>").select(*named))


def _opens_first(spark: SparkSession, path: str, file: str, delimiter: str) -> bool:
    """Whether the first record of a file goes beyond its first split."""
    inside = False
    for r in lines_of(spark, path).where((F.col("file") == file) & (F.col("start") == 0)).toLocalIterator():
        line = bytes(r["value"]).decode("latin-1")
        if not inside and line in ("", "\r"):
            continue
        inside = walk(line, inside, delimiter)[0]
        if not inside:
            return False
    return True


# ---- strict JSON ----


class _Refused(ValueError):
    pass


class _Nested(_Refused):
    pass


def _pairs(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    seen: set[str] = set()
    for key, _ in pairs:
        if key in seen:
            raise _Refused(f"repeats the key {key!r}")
        seen.add(key)
    return dict(pairs)


def _constant(name: str) -> Any:
    raise _Refused(f"holds {name}, which is no JSON")


def strict_value(text: str) -> Any:
    """One JSON value without repeated keys at any depth, NaN or Infinity; a ``ValueError`` says what is wrong, never the content."""
    try:
        return json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant)
    except json.JSONDecodeError as e:
        raise _Refused(f"is no JSON at line {e.lineno}, column {e.colno}: {e.msg}") from None
    except RecursionError:
        raise _Refused("is nested too deeply") from None


@dataclass(frozen=True)
class RecordLimits:
    keys: int | None = None
    chars: int | None = None


def _kind(v: Any) -> str:
    return "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) and -(2**63) <= v < 2**63 else "wide" if isinstance(v, int) else "double" if isinstance(v, float) else "string"


def check_record(value: Any, limits: RecordLimits) -> list[tuple[str, str | None]]:
    """Keys and kinds of a flat record (None: null), or a refusal."""
    if not isinstance(value, dict):
        what = "an array" if isinstance(value, list) else "null" if value is None else f"a {_kind(value)}"
        raise _Refused(f"is {what}, not an object")
    for key, v in value.items():
        if isinstance(v, (dict, list)):
            raise _Nested(f"holds {'an object' if isinstance(v, dict) else 'an array'} under {key!r}")
    if limits.keys is not None and len(value) > limits.keys:
        raise core.LimitExceededError("max_keys_per_record", limits.keys, len(value))
    if limits.chars is not None and (n := sum(len(str(v)) for v in value.values())) > limits.chars:
        raise core.LimitExceededError("max_record_chars", limits.chars, n)
    return [(k, None if v is None else _kind(v)) for k, v in value.items()]


FACTS = "file string, start long, lines long, records long, bad long, why string, limit string, most long, observed long, keys array<string>, kinds array<string>"


class Facts:
    """What the JSON records of a split, or of a document, hold; the first refusal ends it."""

    def __init__(self, limits: RecordLimits) -> None:
        self.limits = limits
        self.lines = self.records = 0
        self.bad, self.why, self.limit = NONE, None, (None, None, None)
        self.keys: dict[str, set[str]] = {}

    def put(self, value: Any) -> None:
        self.records += 1
        for key, kind in check_record(value, self.limits):
            self.keys.setdefault(key, set()).update({kind} - {None})

    def refuse(self, line: int, e: Exception) -> None:
        if self.bad == NONE:
            self.bad, self.why = line, str(e)
            if isinstance(e, core.LimitExceededError):
                self.limit = (e.limit, e.configured, e.observed)
            elif isinstance(e, _Nested):
                self.limit = (NESTED, None, None)

    def row(self, file: str, start: int) -> tuple:
        return (file, start, self.lines, self.records, self.bad, self.why, *self.limit, list(self.keys), ["+".join(sorted(k)) for k in self.keys.values()])


def fact_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.string())] * 2]
    names = [part.split()[0] for part in FACTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def check_json_lines(spark: SparkSession, path: str, encoding: str, limits: RecordLimits) -> dict[str, set[str]]:
    """Keys and kinds of JSON lines; the first bad line of each file is refused by its number. Blank lines are skipped."""
    codec = CODECS[encoding]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, facts = None, Facts(limits)
        for file, start, values in splits(batches):
            if (file, start) != now:
                if now:
                    yield fact_batch([facts.row(*now)])
                now, facts = (file, start), Facts(limits)
            for line in values:
                number = facts.lines
                facts.lines += 1
                if facts.bad != NONE or not line.strip():
                    continue
                try:
                    if "\0" in line:
                        raise _Refused("holds NUL bytes")
                    text = decoded(line, codec)
                    facts.put(strict_value(text.lstrip("﻿") if start == 0 and number == 0 else text))
                except UnicodeDecodeError:
                    facts.refuse(number, _Refused(f"cannot be decoded as {encoding}"))
                except (ValueError, core.AssayError) as e:
                    facts.refuse(number, e)
        if now:
            yield fact_batch([facts.row(*now)])

    return _judged(lines_of(spark, path).mapInArrow(run, FACTS).collect(), path, "line")  # one row a split


def check_json_documents(spark: SparkSession, path: str, encoding: str, limits: RecordLimits) -> dict[str, set[str]]:
    """The same for files that hold one array of records, or one record, each; a file is one task."""
    codec = CODECS[encoding]
    whole = spark.read.format("binaryFile").load(path).select("content", F.col("path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, file in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                facts, at = Facts(limits), 0
                try:
                    raw = content.as_py()
                    if b"\0" in raw:
                        raise _Refused("holds NUL bytes")
                    value = strict_value(raw.decode(codec).lstrip("﻿")) if raw.strip() else []
                    for at, record in enumerate(value if isinstance(value, list) else [value]):  # noqa: B007
                        facts.put(record)
                except UnicodeDecodeError:
                    facts.refuse(at, _Refused(f"cannot be decoded as {encoding}"))
                except (ValueError, core.AssayError) as e:
                    facts.refuse(at, e)
                yield fact_batch([facts.row(file, 0)])

    return _judged(whole.mapInArrow(run, FACTS).collect(), path, "record")  # one row a file


def _judged(rows: list[Any], path: str, unit: str) -> dict[str, set[str]]:
    keys: dict[str, set[str]] = {}
    records, before, file = 0, 0, None
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        before = before if r["file"] == file else 0
        file = r["file"]
        if r["bad"] != NONE:
            if r["limit"] not in (None, NESTED):
                raise core.LimitExceededError(r["limit"], r["most"], r["observed"])
            number = before + r["bad"] + 1
            error = core.NestedValueError if r["limit"] == NESTED else core.MalformedInputError
            raise error(f"{file.rpartition('/')[2]}: {unit} {number} {r['why']}", number)
        before, records = before + r["lines"], records + r["records"]
        for key, kinds in zip(r["keys"], r["kinds"], strict=True):
            keys.setdefault(key, set()).update(k for k in kinds.split("+") if k)
    if not records:
        raise core.EmptyDataError(f"{path} holds no records")
    return keys
