"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words between single spaces. Of each benchmark
item every ``window // 2``-word piece at a multiple of that many words is a pattern:
any window of ``window`` consecutive words holds one of them whole, so the patterns
have as many characters as the item instead of ``window`` times as many. One
automaton over all patterns scans each text once; where a piece is found, the words
around it are compared with the item's, which gives the windows that occur. Matches
are mapped back to words and to offsets of the original text.

A block of at most ``block_bytes`` of benchmark text is collected and sent to the
tasks at a time. Blocks after the first are scanned one after the other, their hits
are written, and meet those of the first by document.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm._common import Scratch, map_rows, sha, worker_state
from assayer.operators.graph import stored

WINDOW = 10
BLOCK_BYTES = 2 << 20
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of UTF-8: letters A-Z in lower case, anything that ends a word a space.
CLEAN = bytes(c if WORD.match(bytes([c])) else 32 for c in LOWER)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(CLEAN).split()


class Index(NamedTuple):
    """Automaton over pieces; a pattern's value is its number of words and the (row, word) places that it has."""

    automaton: ahocorasick.Automaton
    ids: list[str]  # of each row
    words: list[list[bytes]]
    window: int


def build(items: list[tuple[str, str]], window: int) -> Index | None:
    """The automaton of a block; rows of one text and id are one, an item under ``window`` words is one pattern."""
    ids, texts = [], []
    for item, text in sorted(set(items)):
        if words := words_of(text):
            ids.append(item)
            texts.append(words)
    half = max(1, window // 2)
    places: dict[bytes, tuple[int, list[tuple[int, int]]]] = {}
    for row, words in enumerate(texts):
        step = half if len(words) >= window else len(words)
        for at in range(0, len(words) - step + 1, step):
            piece = b" " + b" ".join(words[at : at + step]) + b" "
            places.setdefault(piece, (step, []))[1].append((row, at))
    if not places:
        return None
    automaton = ahocorasick.Automaton()
    for piece, value in places.items():
        automaton.add_word(piece.decode("latin-1"), value)
    automaton.make_automaton()
    return Index(automaton, ids, texts, window)


def around(words: list[bytes], at: int, item: list[bytes], place: int, size: int, window: int) -> tuple[int, int] | None:
    """Words of the text inside windows that hold the piece found at ``at``, as (first, end)."""
    if len(item) < window:
        return at, at + size
    most = window - size
    left = 0
    while left < min(most, at, place) and words[at - left - 1] == item[place - left - 1]:
        left += 1
    end, stop, right = at + size, place + size, 0
    while right < min(most, len(words) - end, len(item) - stop) and words[end + right] == item[stop + right]:
        right += 1
    return (at - left, end + right) if left + right >= most else None


def scan(text: str, index: Index | None) -> tuple[int, int, list[str], list[tuple[int, int, int, int]]]:
    """Words, hit words, items, and hit runs (first word, end word, start and end in code points)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(CLEAN).split()
    if index is None or not words:
        return len(words), 0, [], []
    flat = b" " + b" ".join(words) + b" "
    found = list(index.automaton.iter(flat.decode("latin-1")))
    if not found:
        return len(words), 0, [], []
    starts = np.cumsum([1, *[len(w) + 1 for w in words]])  # of each word in flat, and one past the end
    after = np.searchsorted(starts, [end + 1 for end, _ in found]).tolist()
    hit = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    for stop, (_, (size, places)) in zip(after, found, strict=True):
        for row, place in places:
            run = around(words, stop - size, index.words[row], place, size, index.window)
            if run:
                hit[run[0]] += 1
                hit[run[1]] -= 1
                items.add(index.ids[row])
    if not items:
        return len(words), 0, [], []
    covered = np.cumsum(hit)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])))).reshape(-1, 2).tolist()
    at = np.fromiter((x for m in WORD.finditer(raw.translate(LOWER)) for x in m.span()), np.int64).reshape(-1, 2)
    points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    runs = [(a, b, int(points[at[a, 0]]) - 1, int(points[at[b - 1, 1] - 1])) for a, b in edges]
    return len(words), int(covered.sum()), sorted(items), runs


PARTS = ("first", "last", "start", "end")
RUNS = pa.list_(pa.struct([(p, pa.int32()) for p in PARTS]))
RUN_SQL = "array<struct<first:int,last:int,start:int,end:int>>"
SCHEMA = f"n_words long, items array<string>, runs {RUN_SQL}"


def scan_block(df: DataFrame, keep: list[str], text_col: str, held, window: int) -> DataFrame:  # noqa: ANN001
    """``keep``, the number of words, the items and the hit runs of each row; ``held`` is a broadcast block."""
    number = held.id if hasattr(held, "id") else id(held)

    def setup():  # noqa: ANN202
        state = worker_state(__name__)  # an automaton is built once a worker and block
        if state.get("block") != (number, window):
            state.pop("index", None)
            state["index"], state["block"] = build(held.value, window), (number, window)
        index = state["index"]

        def work(texts: list[str]) -> dict[str, pa.Array]:
            rows = [scan(t, index) for t in texts]
            return {
                "n_words": pa.array([r[0] for r in rows], pa.int64()),
                "items": pa.array([r[2] for r in rows], pa.list_(pa.string())),
                "runs": pa.array([[dict(zip(PARTS, x, strict=True)) for x in r[3]] for r in rows], RUNS),
            }

        return work

    return map_rows(df, keep, text_col, setup, SCHEMA)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of bounded size: one, unless its texts pass the bound.

    A size is summed first; parts are dealt by a hash of the item's id and text.
    """
    source = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    total = source.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = -(-total // block_bytes) or 1
    if n == 1:
        return [source]
    return [source.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def block_of(part: DataFrame):  # noqa: ANN201
    """A part of the benchmark, of bounded size, as a broadcast."""
    rows = [(r["item"] if r["item"] is not None else "null", r["text"] or "") for r in part.collect()]
    out = part.sparkSession.sparkContext.broadcast(rows)
    out.id = out._jbroadcast.id() if getattr(out, "_jbroadcast", None) is not None else id(out)
    return out


def union_of_runs(runs: Column) -> Column:
    """Sorted runs, those that overlap or touch as one."""

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
        )
        meets = (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last["last"]) >= s["first"])
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(runs), F.array().cast(RUN_SQL), add)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Overlap of every row with a benchmark.

    Returns ``id_col``, other columns named in ``keep``, ``n_words``, ``n_hit`` (words
    inside any occurrence of a window), ``items`` (ids with an occurring window, as
    strings, sorted) and ``spans`` (hit runs of words, code points of the original text).

    Null or empty texts, on either side, have no words and no windows; a null item
    id reads as ``null``; rows of one item id are one item; repeated document rows
    each give a row, rows with a null id too; an empty benchmark hits nothing; other
    columns are not read.
    """
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes)
    own = list(dict.fromkeys([id_col, *keep]))
    if len(blocks) == 1:
        found = scan_block(docs, own, text_col, block_of(blocks[0]), window)
    else:
        # A hash of the text keeps different texts of one id apart; equal rows have equal hits.
        keyed = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
        tables = Scratch(docs.sparkSession, "decontaminate")
        more = None
        for part in blocks[1:]:
            held = block_of(part)
            hits = tables.put(scan_block(keyed, list(dict.fromkeys([id_col, "__row"])), text_col, held, window).where(F.size("items") > 0))
            held.destroy()
            more = hits if more is None else more.unionByName(hits)
        more = stored(
            more.groupBy(F.col(id_col).alias("__id"), F.col("__row").alias("__r")).agg(
                F.flatten(F.collect_set("items")).alias("__items"), F.flatten(F.collect_set("runs")).alias("__runs")
            )
        )
        tables.drop()
        first = scan_block(keyed, [*own, "__row"], text_col, block_of(blocks[0]), window)
        found = first.join(more, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__r")), "left")
        empty = F.array().cast("array<string>")
        found = found.withColumn("items", F.array_sort(F.array_distinct(F.concat("items", F.coalesce("__items", empty)))))
        found = found.withColumn("runs", union_of_runs(F.concat("runs", F.coalesce("__runs", F.array().cast(RUN_SQL)))))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["last"] - r["first"])
    spans = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return found.select(*[F.col(f"`{c}`") for c in own], "n_words", n_hit.alias("n_hit"), "items", spans.alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha(F.concat_ws(",", "items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
