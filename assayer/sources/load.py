"""The one way to load a table: by path, DataFrame, records or record iterable.

Files are read by Spark's readers, so a path may be in any store that Spark
reads, and limits are checked by aggregates. Text is typed by one pass of token
rules over all columns instead of a reader's guess.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer import core
from assayer.sources import structure

FORMATS = {
    "csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "orc": "orc",
    "feather": "arrow", "arrow": "arrow", "sqlite": "sqlite", "sqlite3": "sqlite", "db": "sqlite", "xlsx": "xlsx", "xls": "xls",
}
ENCODINGS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "cp1256": "windows-1256"}
DELIMITERS = (",", ";", "\t", "|")
# Tokens that read as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
INTEGER = r"^\s*[+-]?\d+\s*$"
REAL = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


@dataclass(frozen=True)
class Limits:
    """Bounds of a source; None switches one off. Tables of a cluster's size come with all off."""

    max_source_bytes: int | None = None
    max_rows: int | None = None
    max_columns: int | None = 10_000
    max_cells: int | None = None
    max_field_length: int | None = None
    max_records: int | None = 1_000_000
    max_keys_per_record: int | None = 1_000
    max_record_chars: int | None = None


#: The bounds of a single local file, as an interactive audit uses them.
LOCAL = Limits(64 << 20, 1_000_000, 1_000, 10_000_000, 1_000_000, 1_000_000, 1_000)


@dataclass(frozen=True)
class Options:
    encoding: str = "utf-8"
    delimiter: str | None = None
    header: bool = True

    def __post_init__(self) -> None:
        if self.encoding not in ENCODINGS:
            raise core.ConfigurationError(f"encoding {self.encoding} is not one of {sorted(ENCODINGS)}")


@dataclass(frozen=True)
class Loaded:
    df: DataFrame
    format: str
    notes: dict[str, Any] = field(default_factory=dict)


def resolve_format(path: str) -> str:
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in FORMATS:
        raise core.IngestionError(f"no format for .{suffix}")
    return FORMATS[suffix]


def check_shape(df: DataFrame, limits: Limits) -> DataFrame:
    """Refuse a table beyond its limits; rows and field lengths are one aggregate, run only if asked for."""
    width = len(df.columns)
    if limits.max_columns is not None and width > limits.max_columns:
        raise core.LimitExceededError("max_columns", limits.max_columns, width)
    core.kinds(df)
    if limits.max_rows is None and limits.max_cells is None and limits.max_field_length is None:
        return df
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    longest = F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.max(F.length(f"`{c}`")), F.lit(0)) for c in text])
    rows, field_length = df.agg(F.count("*"), longest).first()
    for name, seen in (("max_rows", rows), ("max_cells", rows * width), ("max_field_length", field_length)):
        if getattr(limits, name) is not None and seen > getattr(limits, name):
            raise core.LimitExceededError(name, getattr(limits, name), seen)
    return df


def choose_delimiter(spark: SparkSession, path: str, encoding: str) -> str:
    """The delimiter under which the first lines have one width of two or more; two such are ambiguous."""
    lines = [r[0] for r in spark.read.option("encoding", encoding).text(path).limit(50).collect()]
    if not lines:
        raise core.EmptyDataError(path)
    import csv

    fitting = []
    for d in DELIMITERS:
        widths = {len(row) for row in csv.reader(lines, delimiter=d) if row}
        if len(widths) == 1 and widths.pop() >= 2:
            fitting.append(d)
    if len(fitting) > 1:
        raise core.IngestionError(f"ambiguous delimiter: {fitting}")
    return fitting[0] if fitting else ","


def read_delimited(spark: SparkSession, path: str, options: Options, default: str | None = None) -> Loaded:
    """All columns as text first, after a scan that refuses what is no table; see ``structure.check_delimited``.

    Files whose records are single lines are read by Spark's own reader; others are read
    split by split, so a quoted line feed costs no parallelism.
    """
    encoding = ENCODINGS[options.encoding]
    delimiter = options.delimiter or default or choose_delimiter(spark, path, encoding)
    shape = structure.check_delimited(spark, path, delimiter, options.encoding, options.header)
    if shape.spans or (options.encoding == "utf-8-sig" and not options.header):
        raw = structure.records_of(spark, path, delimiter, options.encoding, options.header, shape)
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in shape.names])
        raw = spark.read.options(sep=delimiter, encoding=encoding, header=options.header, quote='"', escape='"', nullValue="", enforceSchema=True).schema(schema).csv(path)
    return Loaded(type_text(raw), "csv" if delimiter == "," else "tsv", {"delimiter": delimiter, "rows": shape.records})


def token_kinds(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return (
        F.when(c.isNull() | c.isin(*MISSING), "missing").when(low.isin("true", "false"), "bool")
        .when(c.rlike(INTEGER), "int").when(c.rlike(REAL), "float").otherwise("text")
    )


def type_text(df: DataFrame) -> DataFrame:
    """Types of all columns from one aggregate of token kinds: long, double, boolean or string.

    Any text, or truth values beside numbers, make a string column; a column of
    missing tokens alone is double; whole numbers beyond 18 digits stay exact decimals.
    """
    flags = df.agg(
        *[F.struct(F.collect_set(token_kinds(F.col(f"`{c}`"))).alias("k"), F.max(F.length(F.trim(f"`{c}`"))).alias("n")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    ).first()
    out = []
    for i, c in enumerate(df.columns):
        kinds = set(flags[i]["k"]) - {"missing"}
        x = F.col(f"`{c}`")
        x = F.when(~x.isin(*MISSING), x)
        wide = (flags[i]["n"] or 0) > 18
        if "text" in kinds or ("bool" in kinds and len(kinds) > 1):
            out.append(x.alias(c))
        elif kinds == {"bool"}:
            out.append((F.lower(F.trim(x)) == "true").alias(c))
        elif kinds == {"int"}:
            out.append(F.trim(x).try_cast("decimal(38,0)" if wide else "long").alias(c))
        else:
            plain = F.regexp_replace(F.trim(x), r"(?i)^([+-]?)inf(inity)?$", "$1Infinity")
            out.append(F.regexp_replace(plain, r"^\+", "").try_cast("double").alias(c))
    return df.select(*out)


JSON_KINDS = {
    frozenset({"boolean"}): T.BooleanType(), frozenset({"long"}): T.LongType(), frozenset({"double"}): T.DoubleType(), frozenset({"long", "double"}): T.DoubleType(),
    frozenset({"wide"}): T.DecimalType(38, 0), frozenset({"long", "wide"}): T.DecimalType(38, 0), frozenset({"wide", "double"}): T.DoubleType(), frozenset({"long", "wide", "double"}): T.DoubleType(),
}


def read_json(spark: SparkSession, path: str, options: Options, lines: bool, limits: Limits = Limits()) -> Loaded:
    """Flat objects. Broken text, repeated keys, NaN and Infinity, and nested values are refused by their line.

    The strict scan also says what each key holds, so Spark's reader needs no pass of its own
    for the types. Lines are scanned in splits; a document is one task.
    """
    check = structure.check_json_lines if lines else structure.check_json_documents
    keys = check(spark, path, options.encoding, structure.RecordLimits(limits.max_keys_per_record, limits.max_record_chars))
    schema = T.StructType([T.StructField(k, JSON_KINDS.get(frozenset(kinds), T.StringType())) for k, kinds in keys.items()])
    settings = {"lineSep": "\n"} if lines else {"multiLine": True}
    return Loaded(spark.read.options(mode="FAILFAST", encoding=ENCODINGS[options.encoding], **settings).schema(schema).json(path), "jsonl" if lines else "json")


def read_arrow(spark: SparkSession, path: str) -> Loaded:
    """Arrow IPC files: each is read by the task that holds its bytes, as Spark has no reader of its own."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path)

    def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                yield from pa.ipc.open_file(pa.py_buffer(raw.as_py())).read_all().to_batches()

    def schemas(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.ipc.open_file(pa.py_buffer(raw.as_py())).schema.serialize().to_pybytes() for raw in batch.column("content")]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["schema"])

    first = files.select("content").limit(1).mapInArrow(schemas, "schema binary").collect()  # a schema, not the file
    if not first:
        raise core.EmptyDataError(path)
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(first[0][0]))))
    return Loaded(files.select("content").mapInArrow(tables, schema), "arrow")


def read_sqlite(spark: SparkSession, path: str, table: str | None) -> Loaded:
    """One ordinary table of a local file, read-only, in row-id ranges.

    A SQLite file is a single local database: it is opened where it lies, on the
    driver, and its rows are dealt out from there within LOCAL limits.
    """
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as base:
        base.execute("PRAGMA query_only = 1")
        names = [r[0] for r in base.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' AND sql NOT LIKE 'CREATE VIRTUAL%' ORDER BY name")]
        if table is None and len(names) != 1:
            raise core.IngestionError(f"name one of the tables {names}")
        name = table or names[0]
        if name not in names:
            raise core.IngestionError(f"no table {name}")
        quoted = '"' + name.replace('"', '""') + '"'
        rows = base.execute(f"SELECT count(*) FROM {quoted}").fetchone()[0]
        if rows > LOCAL.max_rows:
            raise core.LimitExceededError("max_rows", LOCAL.max_rows, rows)
        cursor = base.execute(f"SELECT * FROM {quoted}")
        columns = [d[0] for d in cursor.description]
        data = cursor.fetchall()
    kinds = []
    for i, c in enumerate(columns):
        seen = {type(r[i]) for r in data} - {type(None)}
        kind = {frozenset({int}): T.LongType(), frozenset({float}): T.DoubleType(), frozenset({int, float}): T.DoubleType(), frozenset({bytes}): T.BinaryType()}.get(frozenset(seen), T.StringType())
        kinds.append(T.StructField(c, kind))
    cast = [tuple(None if v is None else float(v) if isinstance(k.dataType, T.DoubleType) else str(v) if isinstance(k.dataType, T.StringType) else v for v, k in zip(r, kinds, strict=True)) for r in data]
    return Loaded(spark.createDataFrame(cast, T.StructType(kinds)), "sqlite", {"table": name})


def from_records(spark: SparkSession, records: Iterable[Mapping[str, Any]], limits: Limits) -> Loaded:
    """Union of keys in order of appearance; a missing key is a missing cell. At most one item past the limit is taken."""
    most = limits.max_records
    taken = list(itertools.islice(records, None if most is None else most + 1))
    if most is not None and len(taken) > most:
        raise core.LimitExceededError("max_records", most, len(taken))
    names: dict[str, None] = {}
    for r in taken:
        if not isinstance(r, Mapping) or not all(isinstance(k, str) for k in r):
            raise core.IngestionError("records are mappings with text keys")
        if limits.max_keys_per_record is not None and len(r) > limits.max_keys_per_record:
            raise core.LimitExceededError("max_keys_per_record", limits.max_keys_per_record, len(r))
        names |= dict.fromkeys(r)
    fields = []
    for n in names:
        seen = {type(r.get(n)) for r in taken} - {type(None)}
        if seen & {dict, list, tuple, set}:
            raise core.SchemaError(f"{n} is nested")
        kind = T.BooleanType() if seen == {bool} else T.LongType() if seen == {int} else T.DoubleType() if seen and seen <= {int, float} else T.StringType()
        fields.append(T.StructField(n, kind))
    read = {T.DoubleType: float, T.StringType: str, T.LongType: int, T.BooleanType: bool}
    rows = [tuple(None if r.get(f.name) is None else read[type(f.dataType)](r[f.name]) for f in fields) for r in taken]
    return Loaded(spark.createDataFrame(rows, T.StructType(fields)), "records", {"incomplete": sum(len(r) < len(names) for r in taken)})


def load_table(spark: SparkSession, source: Any, options: Options = Options(), limits: Limits = Limits(), table: str | None = None) -> Loaded:
    """Load a path, a DataFrame, or records; anything else is refused."""
    if isinstance(source, DataFrame):
        loaded = Loaded(source, "dataframe")
    elif isinstance(source, str):
        if limits.max_source_bytes is not None:
            size = spark.read.format("binaryFile").load(source).agg(F.sum("length")).first()[0] or 0
            if size > limits.max_source_bytes:
                raise core.LimitExceededError("max_source_bytes", limits.max_source_bytes, size)
        kind = resolve_format(source)
        if kind in ("csv", "tsv"):
            loaded = read_delimited(spark, source, options, "\t" if kind == "tsv" else None)
        elif kind in ("json", "jsonl"):
            loaded = read_json(spark, source, options, kind == "jsonl", limits)
        elif kind in ("parquet", "orc"):
            loaded = Loaded(spark.read.format(kind).load(source), kind)
        elif kind == "arrow":
            loaded = read_arrow(spark, source)
        elif kind == "sqlite":
            loaded = read_sqlite(spark, source, table)
        else:
            raise core.MissingDependencyError(f"no reader of {kind} workbooks is installed")
    elif isinstance(source, (bytes, Mapping, set, range)) or not isinstance(source, Iterable):
        raise core.IngestionError(f"cannot load a {type(source).__name__}")
    else:
        loaded = from_records(spark, source, limits)
    check_shape(loaded.df, limits)
    return loaded
