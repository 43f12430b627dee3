"""Near-duplicate classes by DartMinHash and banded joining.

A document is the weighted set of its word shingles. DartMinHash throws hashed
darts at the plane of element weight by rank. The plane is cut into regions, dyadic
in weight and in rank; the darts of a region depend on the element and the region
alone, and a document keeps those under its weights. Ranks are searched upwards
until every coordinate of the signature has a dart; the earliest dart of each
coordinate is its value. Two documents agree in a coordinate with the probability
of their weighted Jaccard similarity. The cost is some darts a coordinate and a
region or so an element and doubling of weight, not elements times coordinates.

Bands of the signatures join candidates, in two steps that both check the exact
similarity of the texts and keep every link of a bucket:

1. Each member of a bucket meets the bucket's most central member, the one that
   shares most bands with others. What is alike forms a class, so a large group of
   near copies is one class at the cost of one pair a member.
2. Members of buckets that still hold several classes are compared across classes,
   but only pairs that can reach the threshold: under one order of all shingles, rare
   ones first, two alike documents share a shingle so early that the rest of both is
   still heavy enough. Documents that merely share a common passage have it at the end.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._common import Scratch, bounded, worker_state
from assayer.operators.graph import components, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 30
ROWS = 7  # at similarity 0.8 a pair shares no band with probability (1 - 0.8**7)**30 = 9e-4, at 0.85 with 9e-6
WORD = re.compile(r"\w+")
U64 = np.uint64
FLOOR = 4  # the first region of the weights [0, 1) has the ranks [0, 1/16)
HELD = 1_000_000  # ids of candidates that are broadcast, at most; more are joined by shuffling the texts
ELEMENTS = 1 << 16  # elements, or characters, that a numpy call handles
TOGETHER = 1 << 20  # bytes of texts that are hashed together; some 20 times as many are held meanwhile
SLOTS = 1 << 18  # counters of the shingle frequencies that order shingles


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """Of each code point, whether it is one of ``WORD``."""
    out = np.zeros(0x110000, bool)
    for m in WORD.finditer(np.arange(len(out), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        out[m.start() : m.end()] = True
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of all texts in order, and each text's number of words.

    Words are told apart by the sums of their mixed pairs of character and place, so that a string is made
    and hashed for each different word only.
    """
    lower = [t.lower() for t in texts]
    whole = "\n".join(["", *lower, ""])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = word_characters()[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    past = np.cumsum([1 + len(t) for t in lower])  # where a text ends
    counts = np.diff(np.searchsorted(begin, past), prepend=0)
    sums, done = np.empty(len(begin), U64), 0
    while done < len(begin):  # some characters at once, or one word
        upto = max(done + 1, int(np.searchsorted(end, begin[done] + ELEMENTS, side="right")))
        part = slice(begin[done], end[upto - 1])
        long = end[done:upto] - begin[done:upto]
        ahead = np.cumsum(long) - long
        place = np.arange(1, long.sum() + 1, dtype=U64) - np.repeat(ahead, long).astype(U64)
        sums[done:upto] = np.add.reduceat(mix((place << U64(21)) + points[part][inside[part]]), ahead)
        done = upto
    coded = pa.array(sums).dictionary_encode()
    at = coded.indices.to_numpy()
    some = np.empty(len(coded.dictionary), np.int64)
    some[at] = np.arange(len(at))  # an occurrence of each different word
    different = [whole[a:b].encode("utf-8", "surrogatepass") for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
    made = b"".join([hashlib.blake2b(word, digest_size=8).digest() for word in different])
    return np.frombuffer(made, "<u8")[at], counts


def hashed_all(texts: list[str], size: int, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of the texts, one after the other: sorted 64-bit hashes of each text, their weights, and where each text ends.

    Shingles are of lower-case words; a text of fewer words is one shingle. Weights are counts, or 1 if not ``weighted``.
    """
    words, counts = word_hashes(texts)
    made = np.where(counts >= size, counts - size + 1, counts > 0)
    ends = np.cumsum(made)
    h = np.empty(made.sum(), U64)
    length = np.minimum(counts, size)
    # The first word of each shingle: the text's first one and those that follow.
    start = np.arange(len(h)) + np.repeat(np.cumsum(counts) - counts - (ends - made), made)
    of = np.repeat(length, made)
    for n in np.unique(of).tolist():
        at = start[of == n]
        part = np.full(len(at), n, U64)
        for i in range(n):
            part = mix(part * U64(0x9E3779B97F4A7C15) + words[at + i])
        h[of == n] = part
    for low, high in zip((ends - made).tolist(), ends.tolist(), strict=True):
        h[low:high].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[(ends - made)[made > 0]] = True
    at = np.flatnonzero(new)
    weights = np.diff(at, append=len(h)).astype(np.float64) if weighted else np.ones(len(at))
    return h[at], weights, np.searchsorted(at, ends)


def hashed(text: str, size: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """``hashed_all`` of one text: its shingles and their weights."""
    return hashed_all([text], size, weighted)[:2]


def apart(texts: list[str], size: int, weighted: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``hashed`` of each text, made together."""
    h, w, ends = hashed_all(texts, size, weighted)
    low = 0
    for high in ends.tolist():
        yield h[low:high], w[low:high]
        low = high


S30, S27, S31 = U64(30), U64(27), U64(31)
M1, M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    y = x >> S30
    y ^= x
    y *= M1
    z = y >> S27
    y ^= z
    y *= M2
    np.right_shift(y, S31, out=z)
    y ^= z
    return y


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


@lru_cache(maxsize=256)
def poisson_steps(area: float) -> np.ndarray:
    """Distribution function of the number of darts in a cell, to where double precision ends."""
    most = int(area + 12 * math.sqrt(area) + 24)
    logs = [n * math.log(area) - area - math.lgamma(n + 1) for n in range(most)]
    return np.cumsum(np.exp(logs))


def weight_cell(v: int) -> tuple[float, float]:
    """[0, 1), [1, 2), [2, 4), [4, 8) and so on."""
    return (2.0 ** (v - 1) if v else 0.0), 2.0**v


def rank_cell(v: int, number: int) -> tuple[float, float]:
    """Of a weight cell the ranks [0, r), [r, 2r), [2r, 4r) and so on; a wider weight cell starts with a smaller r."""
    first = 2.0 ** -(FLOOR + max(0, v - 1))
    return (first * 2.0 ** (number - 1) if number else 0.0), first * 2.0**number


def throw(elements: np.ndarray, weights: np.ndarray, v: np.ndarray, number: int) -> tuple[np.ndarray, ...]:
    """Darts under the weights in region ``number`` of the elements' weight cells ``v``: of which row, rank and name."""
    most = int(v.max(initial=0)) + 1
    salt = (np.arange(most) * 4_096 + number + 1).astype(U64) * U64(0x9E3779B97F4A7C15)
    low, high = np.array([rank_cell(i, number) for i in range(most)]).T
    bottom, top = np.array([weight_cell(i) for i in range(most)]).T
    seed = mix(elements + salt[v])
    chance = uniform(seed)
    steps = poisson_steps(2.0 ** (max(number, 1) - 1 - FLOOR))  # a region is as large in every weight cell
    hit = np.flatnonzero(chance >= steps[0])
    count = np.searchsorted(steps, chance[hit], side="right")
    at = np.repeat(hit, count)
    nth = np.arange(1, len(at) + 1) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(seed[at] + nth.astype(U64) * U64(0xD1B54A32D192ED03))
    part = np.flatnonzero((weights < top[v])[at])  # their cell is not wholly under the weight
    if len(part):
        row = at[part]
        over = bottom[v[row]] + uniform(mix(dart[part] + U64(2))) * (top - bottom)[v[row]] >= weights[row]
        kept = np.ones(len(at), bool)
        kept[part[over]] = False
        at, dart = at[kept], dart[kept]
    cell = v[at]
    rank = low[cell] + uniform(mix(dart + U64(1))) * (high - low)[cell]
    return at, rank, dart


def signatures(elements: np.ndarray, weights: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The k earliest darts of each set, a row a set; ``elements`` are 64-bit hashes, ``weights`` positive.

    The sets follow each other and end at ``ends``; none is empty. Small sets go together.
    """
    out = np.empty((len(ends), k), U64)
    done = 0
    while done < len(ends):
        low = int(ends[done - 1]) if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, low + ELEMENTS, side="right")))
        high = int(ends[upto - 1])
        out[done:upto] = earliest(elements[low:high], weights[low:high], ends[done:upto] - low, k)
        done = upto
    return out


def earliest(elements: np.ndarray, weights: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    starts = np.concatenate([[0], ends[:-1]])
    goal = 2.0 ** np.ceil(np.log2((k * math.log(k) + 2 * k) / np.add.reduceat(weights, starts)))
    # An element is a row in each weight cell that it reaches.
    cells = range(1 + max(0, math.ceil(math.log2(float(weights.max())))))
    reach = [np.flatnonzero(weights > weight_cell(v)[0]) if v else np.arange(len(weights)) for v in cells]
    of = np.repeat(np.arange(len(ends)), ends - starts)
    row, v = np.concatenate(reach), np.repeat(np.array(cells, np.int16), [len(x) for x in reach])
    element, weight, owner = elements[row], weights[row], of[row]
    done = np.zeros(len(row), np.int16)  # regions of each row that have been thrown
    best, value = np.full(len(ends) * k, np.inf), np.zeros(len(ends) * k, U64)
    while True:
        # Ranks [0, r), [r, 2r), [2r, 4r) and so on up to the goal, at least the first.
        need = 1 + np.maximum(0, np.log2(goal)[owner] + FLOOR + np.maximum(0, v - 1)).astype(np.int16)
        order = np.argsort(-need, kind="stable")  # then the rows that a region needs come first
        element, weight, owner, v, done, need = (x[order] for x in (element, weight, owner, v, done, need))
        thrown = []
        for number in range(int(done.min()), int(need[0])):
            part = slice(0, int(np.searchsorted(-need, -number, side="left")))
            if done[part].any():
                part = np.flatnonzero(done[part] <= number)
            at, rank, dart = throw(element[part], weight[part], v[part], number)
            place = (mix(dart + U64(3)) % U64(k)).astype(np.int64)
            thrown.append((owner[part][at] * k + place, rank, dart))
        if thrown:
            place, rank, dart = (np.concatenate(x) for x in zip(*thrown, strict=True))
            np.minimum.at(best, place, rank)
            found = best[place] == rank
            value[place[found]] = dart[found]
        late = best.reshape(-1, k).max(axis=1) > goal  # else all ranks up to the goal have been searched in every weight cell
        if not late.any():
            return value.reshape(-1, k)
        goal[late] *= 2
        left = late[owner]
        element, weight, owner, v, done = element[left], weight[left], owner[left], v[left], need[left]


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """``signatures`` of one set."""
    return signatures(elements, weights, np.array([len(elements)]), k)[0]


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One bucket a band of each signature (a row of ``values``); the band's number is part of it."""
    h = np.repeat(mix(np.arange(1, bands + 1, dtype=U64))[None, :], len(values), axis=0)
    for i in range(rows):
        h = mix(h + values[:, i * bands : (i + 1) * bands] + U64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum() if len(common) else 0.0
    return float(both / (a[1].sum() + b[1].sum() - both)) if both else 0.0


def plain(column: pa.Array) -> list[str]:
    """Texts of a column, null read as empty."""
    return [t or "" for t in column.to_pylist()]


def set_key(h: np.ndarray, w: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes() + w.tobytes(), digest_size=16).digest()


def sketched(df: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """Of each row with words: ``id``, ``same`` (hash of the whole set) and ``keys`` (its buckets)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(__name__)
        for batch in bounded(batches, 1, most=TOGETHER):
            h, w, ends = hashed_all(plain(batch.column(1)), size, weighted)
            sizes = np.diff(ends, prepend=0)
            some = np.flatnonzero(sizes)
            ends = ends[some]
            same = [set_key(h[high - n : high], w[high - n : high]) for n, high in zip(sizes[some].tolist(), ends.tolist(), strict=True)]
            keys = band_keys(signatures(h, w, ends, bands * rows), bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(same, pa.binary()), lists], names=["id", "same", "keys"])

    source = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {kind}, same binary, keys array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, size: int, weighted: bool) -> DataFrame:
    """Pairs (a, b) whose exact similarity reaches the threshold; of an id with several texts any may."""
    both = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", "ta", "tb")
    )
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(__name__)
        for batch in bounded(batches, 2, 3, most=TOGETHER):
            left, right = plain(batch.column(2)), plain(batch.column(3))
            different = list(dict.fromkeys([*left, *right]))
            held = dict(zip(different, apart(different, size, weighted), strict=True))
            good = pa.array([similarity(held[x], held[y]) >= threshold - 1e-12 for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (rep, class) after joining the classes of each link's ends."""
    ends = links
    for side in ("a", "b"):
        ends = ends.join(classes.select(F.col("rep").alias(side), F.col("class").alias(f"c{side}")), side)
    ends = stored(ends.where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if not ends.limit(1).count():
        return classes
    up = components(ends).select(F.col("id").alias("class"), F.col("class").alias("up"))
    return classes.join(up, "class", "left").select("rep", F.coalesce("up", "class").alias("class"))


def central_pairs(full: DataFrame) -> DataFrame:
    """One pair (a, b) for each member b of a bucket: a is the most central of its buckets' leaders.

    ``full`` has the buckets of two or more: ``bucket``, ``rep`` and ``n``, their size. A member
    is central by the sum of its buckets' sizes, among equals the least.
    """
    rank = F.struct((-F.col("score")).alias("low"), F.col("rep").alias("lead"))
    scored = full.join(full.groupBy("rep").agg(F.sum("n").alias("score")), "rep").select("bucket", "rep", rank.alias("rank"))
    leads = scored.groupBy("bucket").agg(F.min("rank").alias("top"))
    best = full.select("bucket", "rep").join(leads, "bucket").groupBy("rep").agg(F.min("top").alias("top"))
    return best.select(F.col("top.lead").alias("a"), F.col("rep").alias("b")).where("a != b")


def slot_counts(texts: DataFrame, size: int, weighted: bool) -> np.ndarray:
    """How often shingles occur, by hashed slot; ``SLOTS`` numbers whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(__name__)
        counts = np.zeros(SLOTS, np.int64)
        for batch in bounded(batches, 0, most=TOGETHER):
            h, _, _ = hashed_all(plain(batch.column(0)), size, weighted)
            counts += np.bincount((h % U64(SLOTS)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 10_000):
            part = used[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["slot", "n"])

    rows = texts.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def early_shingles(texts: DataFrame, counts: np.ndarray, threshold: float, size: int, weighted: bool) -> DataFrame:
    """The shingles of ``texts`` (rep, class, text) by which an alike document can be found.

    Rows of ``rep``, ``class``, ``token``, the document's ``whole`` weight and ``rest``, its weight
    from this shingle on in the common order: rare slots first, then by hash. A document ends where
    the rest falls under the threshold's part of the whole.
    """
    held = texts.sparkSession.sparkContext.broadcast(counts)
    kind = texts.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(__name__)
        for batch in bounded(batches, 2, most=TOGETHER):
            at, tokens, rests, wholes = [], [], [], []
            for i, (h, w) in enumerate(apart(plain(batch.column(2)), size, weighted)):
                order = np.lexsort((h, held.value[(h % U64(SLOTS)).astype(np.int64)]))
                h, w = h[order], w[order]
                rest = np.cumsum(w[::-1])[::-1]
                early = rest >= threshold * w.sum() - 1e-9
                tokens.append(h[early])
                rests.append(rest[early])
                at += [i] * len(tokens[-1])
                wholes.append(np.full(len(tokens[-1]), w.sum()))
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(where), batch.column(1).take(where), pa.array(np.concatenate(tokens).view(np.int64)),
                    pa.array(np.concatenate(wholes)), pa.array(np.concatenate(rests)),
                ],
                names=["rep", "class", "token", "whole", "rest"],
            )

    return texts.select("rep", "class", "text").mapInArrow(run, f"rep {kind}, class {kind}, token long, whole double, rest double")


def possible_pairs(early: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes that share an early shingle with enough weight from there on.

    Of the members of a shingle those of its largest class only meet the others, so a
    class of many near copies gives no pairs of its own.
    """
    sizes = early.groupBy("token", "class").agg(F.count("*").alias("n"))
    top = sizes.groupBy("token").agg(F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("k")).where("k > 1")
    mixed = early.join(top.select("token", F.col("top.class").alias("most")), "token")
    x = mixed.where("class != most").select("token", *[F.col(c).alias(f"x_{c}") for c in ("rep", "class", "whole", "rest")])
    y = mixed.select("token", "rep", "class", "whole", "rest", (F.col("class") == F.col("most")).alias("in_most"))
    alike = F.least("rest", "x_rest") * (1 + threshold) >= threshold * (F.col("whole") + F.col("x_whole")) - 1e-6
    once = F.col("in_most") | (F.col("x_rep") < F.col("rep"))
    pairs = x.join(y, (x["token"] == y["token"]) & (F.col("x_class") != F.col("class")) & once & alike)
    return pairs.select(F.least("rep", "x_rep").alias("a"), F.greatest("rep", "x_rep").alias("b")).distinct()


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = SIMILARITY,
    size: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    weighted: bool = False,
) -> DataFrame:
    """Near-duplicate class of every row: ``id_col`` and ``class_id``, its least id.

    Rows are of one class if a chain of links joins them; a link is a similarity of
    at least ``threshold`` between shingle sets (``weighted``: multisets) of rows that
    share a band. Rows with a null, empty or wordless text are classes of their own,
    rows of one id share a class whatever their texts, and each of these texts may
    link; rows with a null id have a null class. Repeated rows are kept; an empty
    table gives no rows; other columns are not read.
    """
    tables = Scratch(df.sparkSession, "near-dedup")
    sketches = tables.put(sketched(df, id_col, text_col, size, bands, rows, weighted))
    # Equal sets are one representative before anything is joined.
    heads = tables.put(sketches.groupBy("same").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")))
    keys = heads.select("rep", F.explode("keys").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")  # only these can link
    full = tables.put(keys.join(shared, "bucket").select("bucket", "rep", "n"))
    member = tables.put(sketches.select("id", "same").join(heads.select("same", "rep"), "same").select("id", "rep"))
    classes = heads.select("rep", F.col("rep").alias("class")).distinct()
    wanted = tables.put(full.select(F.col("rep").alias("id")).distinct())
    few = wanted.limit(HELD + 1).count() <= HELD  # then no text is shuffled to find the candidates
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(wanted) if few else wanted, "id", "left_semi"
    )
    repeated = bool(sketches.groupBy("id").count().where("count > 1").limit(1).count())
    if repeated:
        texts = texts.dropDuplicates(["id", "text"])
        member = member.distinct()
    texts = tables.put(texts)
    own = member.groupBy("id").agg(F.min("rep").alias("low")) if repeated else member.withColumnRenamed("rep", "low")
    if repeated:
        same_id = member.join(own, "id").where("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
        classes = tables.put(merged(classes, same_id))

    links = tables.put(verified(central_pairs(full), texts, threshold, size, weighted))
    classes = tables.put(merged(classes, links))

    placed = full.select("bucket", "rep").join(classes, "rep")
    mixed = placed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high")
    open_ = placed.join(mixed.select("bucket"), "bucket").select("rep", "class").distinct()
    open_texts = tables.put(open_.join(texts, F.col("rep") == F.col("id")).select("rep", "class", "text"))
    early = tables.put(early_shingles(open_texts, slot_counts(open_texts, size, weighted), threshold, size, weighted))
    pairs = tables.put(possible_pairs(early, threshold))
    classes = merged(classes, verified(pairs, open_texts.select(F.col("rep").alias("id"), "text"), threshold, size, weighted))

    result = stored(
        df.select(F.col(id_col).alias("id"))
        .join(own.join(classes, F.col("low") == F.col("rep")).select("id", "class"), "id", "left")
        .select(F.col("id").alias(id_col), F.coalesce("class", "id").alias("class_id"))
    )
    tables.drop()
    return result
