"""Datetime cadence, gaps and strict ISO recognition."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.core import ConfigurationError
from assayer.operators.graph import stored

DURATION = re.compile(r"P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,6}))?S)?)?")


def parse_cadence(text: str) -> int:
    """ISO-8601 duration of fixed length in microseconds; must be positive."""
    m = DURATION.fullmatch(text)
    if not m or not any(m.groups()):
        raise ConfigurationError(f"not a fixed duration: {text}")
    w, d, h, mi, s = (int(x or 0) for x in m.groups()[:5])
    micros = ((((w * 7 + d) * 24 + h) * 60 + mi) * 60 + s) * 1_000_000 + int((m[6] or "0").ljust(6, "0"))
    if micros <= 0:
        raise ConfigurationError("a cadence must be positive")
    return micros


def format_duration(micros: int) -> str:
    sign, micros = "-" if micros < 0 else "", abs(micros)
    seconds, rest = divmod(micros, 1_000_000)
    days, seconds = divmod(seconds, 86_400)
    hours, seconds = divmod(seconds, 3_600)
    minutes, seconds = divmod(seconds, 60)
    fraction = f".{rest:06d}".rstrip("0") if rest else ""
    time = (f"{hours}H" if hours else "") + (f"{minutes}M" if minutes else "") + (f"{seconds}{fraction}S" if seconds or rest else "")
    out = (f"{days}D" if days else "") + (f"T{time}" if time else "")
    return f"{sign}P{out or 'T0S'}"


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def spacings(df: DataFrame, column: str) -> DataFrame:
    """Distances between consecutive distinct timestamps: ``day``, ``at`` and ``delta`` (microseconds).

    Timestamps are ranged by themselves and stored, so a day with all events is many tasks. The window runs within
    ranges, and the first of a range looks back to the last of the range before; only a row a
    range is ordered in one task.
    """
    stamps = df.where(F.col(column).isNotNull()).select(micros(F.col(column)).alias("at")).distinct()
    ranged = stored(stamps.repartitionByRange("at").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.max("at").alias("last"))
    before = ends.withColumn("before", F.lag("last").over(Window.orderBy("part"))).select("part", "before")
    prior = F.coalesce(F.lag("at").over(Window.partitionBy("part").orderBy("at")), F.col("before"))
    day = F.floor(F.col("at") / 86_400_000_000).alias("day")
    return ranged.join(F.broadcast(before), "part").select(day, "at", (F.col("at") - prior).alias("delta"))


def summarize(df: DataFrame, column: str, cadence: str | None = None) -> DataFrame:
    """One row: counts, endpoints, spacing, regularity and, with a cadence, gaps on its grid."""
    c = F.col(column)
    totals = df.agg(
        F.count("*").alias("rows"), F.count(c).alias("valid"), F.count_if(c.isNull()).alias("missing"),
        F.min(micros(c)).alias("first_micros"), F.max(micros(c)).alias("last_micros"),
    )
    gaps = spacings(df, column)
    spaced = gaps.agg(
        F.count("*").alias("distinct"), F.min("delta").alias("min_spacing"), F.max("delta").alias("max_spacing"),
    ).withColumn("regular", (F.col("distinct") > 1) & (F.col("min_spacing") == F.col("max_spacing")))
    kinds = gaps.where("delta IS NOT NULL").groupBy("delta").count().agg(F.count("*").alias("distinct_spacings"))
    out = totals.join(F.broadcast(spaced)).join(F.broadcast(kinds)).withColumn("duplicates", F.col("valid") - F.col("distinct"))
    if cadence is None:
        return out
    return out.join(F.broadcast(grid_gaps(df, column, cadence)))


def grid_gaps(df: DataFrame, column: str, cadence: str) -> DataFrame:
    """Points off the grid that starts at the first timestamp, and the grid points that are missing."""
    step = parse_cadence(cadence)
    at = df.where(F.col(column).isNotNull()).select(micros(F.col(column)).alias("at"))
    first = at.agg(F.min("at").alias("origin"), F.max("at").alias("last"))
    on = at.join(F.broadcast(first)).select("at", "origin", "last", F.pmod(F.col("at") - F.col("origin"), F.lit(step)).alias("off"))
    counts = on.agg(
        F.count_distinct(F.when(F.col("off") != 0, F.col("at"))).alias("off_grid"),
        F.count_distinct(F.when(F.col("off") == 0, F.col("at"))).alias("on_grid"),
        F.first("origin").alias("origin"), F.first("last").alias("last"),
    )
    grid = on.where("off = 0").select(F.col("at")).distinct()
    runs = spacings(grid.select(F.timestamp_micros("at").alias("t")), "t").where(F.col("delta") > step)
    gaps = runs.agg(F.count("*").alias("inner_gaps"), F.max("delta").alias("widest"), F.max("at").alias("__x")).drop("__x")
    tail = grid.agg(F.max("at").alias("last_on"))
    points = F.floor((F.col("last") - F.col("origin")) / step) + 1
    trailing = F.floor((F.col("last") - F.col("last_on")) / step)
    return counts.join(F.broadcast(gaps)).join(F.broadcast(tail)).select(
        "off_grid", (points - F.col("on_grid")).alias("missing_points"),
        (F.col("inner_gaps") + F.when(trailing > 0, 1).otherwise(0)).alias("gap_runs"), trailing.alias("trailing_missing"),
    )


ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def iso_kind(c: Column) -> Column:
    """date, naive, utc_z or explicit_offset for a strict ISO text, NULL otherwise."""
    part = lambda i: F.regexp_extract(c, ISO, i)
    date = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    zone = part(7)
    clock = (
        (part(4) == "")
        | ((part(4) <= "23") & (part(5) <= "59") & (part(6) <= "59"))
    )
    offset = (zone == "") | (zone == "Z") | ((F.substring(zone, 2, 2) <= "23") & (F.substring(zone, 5, 2) <= "59"))
    valid = c.rlike(ISO) & date.isNotNull() & (part(1) != "0000") & clock & offset
    return F.when(
        valid,
        F.when(part(4) == "", "date").when(zone == "", "naive").when(zone == "Z", "utc_z").otherwise("explicit_offset"),
    )


def recognize_iso(df: DataFrame, columns: list[str], least: int = 8) -> DataFrame:
    """Of each text column: blanks, seen values, and its zone policy if every value is strict ISO."""
    parts = []
    for name in columns:
        c = F.col(name)
        present = c.isNotNull() & (c != "")
        k = iso_kind(c)
        seen = F.count_if(present)
        policies = F.array_sort(F.collect_set(F.when(present, k)))
        every = (F.count_if(present & k.isNull()) == 0) & (seen >= least)
        parts.append(
            F.struct(
                F.lit(name).alias("column"), seen.alias("seen"), F.count_if(~F.coalesce(present, F.lit(False))).alias("blank"),
                F.when(every, F.when(F.size(policies) == 1, policies[0]).otherwise("mixed")).alias("policy"),
            )
        )
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
