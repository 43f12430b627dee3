"""Quality of a text from its bytes by a convolutional network in numpy.

Each byte has a learned vector; learned filters slide over the bytes. A document is cut
into chunks that overlap by one byte less than a filter, so that every window of the
whole text lies in exactly one chunk. Filters are max-pooled in each chunk; the largest,
least and mean chunk of each filter pass a small hidden layer to one probability.

The network is fitted on a bounded number of labelled texts; scoring is one pass over
all texts without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm._common import map_rows

WIDTH = 8  # bytes of a filter
EMBED = 8  # numbers of a byte's vector
FILTERS = 32
HIDDEN = 16
CHUNK = 256  # bytes of a chunk
PAD = 256  # the symbol after a text's last byte
TRAIN_ROWS = 1024  # texts of each label that are fitted on, at most,
TRAIN_BYTES = 16 << 10  # and their size; longer texts are scored whole but not fitted on
BATCH = 32
TURNS = 400  # batches fitted on, each half good, half bad
LEAK = 0.1
WINDOWS_AT_ONCE = 1 << 15
CUT = 0.3


@dataclass
class Network:
    """Weights by name, and the log odds of good texts, as batches are half good and half bad."""

    weights: dict[str, np.ndarray]
    shift: float = 0.0

    @staticmethod
    def drawn(seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        normal = lambda *shape, by: (draw.standard_normal(shape) * by).astype(np.float32)
        return Network({
            "bytes": normal(PAD + 1, EMBED, by=0.5),
            "filters": normal(WIDTH * EMBED, FILTERS, by=1 / math.sqrt(WIDTH * EMBED)),
            "start": np.zeros(FILTERS, np.float32),
            "hidden": normal(3 * FILTERS, HIDDEN, by=1 / math.sqrt(3 * FILTERS)),
            "hidden_start": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, by=1 / math.sqrt(HIDDEN)),
            "out_start": np.zeros(1, np.float32),
        })


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with pads after each text, the start of each chunk's windows and of each run of pads, and the text of each (-1 for pads).

    A window starts at every byte; a chunk's windows start at ``CHUNK - WIDTH + 1`` bytes in a row.
    """
    step = CHUNK - WIDTH + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    symbols = np.full(int(sizes.sum()) + WIDTH * len(texts), PAD, np.uint16)
    starts, of, at = [], [], 0
    for i, t in enumerate(texts):
        symbols[at : at + len(t)] = np.frombuffer(t, np.uint8)
        own = np.arange(at, at + len(t), step)
        starts += [own, [at + len(t)]]
        of += [np.full(len(own), i), [-1]]
        at += len(t) + WIDTH
    return symbols, np.concatenate(starts).astype(np.int64), np.concatenate(of).astype(np.int64)


def windows(net: Network, symbols: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The embedded windows that start in [begin, end), one a row."""
    vectors = net.weights["bytes"][np.concatenate((symbols[begin : end + WIDTH - 1], np.full(max(0, end + WIDTH - 1 - len(symbols)), PAD, np.uint16)))]
    return sliding_window_view(vectors, WIDTH, axis=0).transpose(0, 2, 1).reshape(end - begin, WIDTH * EMBED)


def chunk_maxima(net: Network, symbols: np.ndarray, starts: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest response of each filter in each chunk (rectified), and, if asked for, the window that gave it."""
    ends = np.append(starts[1:], len(symbols))
    top = np.empty((len(starts), FILTERS), np.float32)
    where = np.empty((len(starts), FILTERS), np.int64) if places else None
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + WINDOWS_AT_ONCE, side="right")))
        begin, end = int(starts[at]), int(ends[to - 1])
        response = windows(net, symbols, begin, end) @ net.weights["filters"]
        own = starts[at:to] - begin
        top[at:to] = np.maximum.reduceat(response, own, axis=0)
        if where is not None:
            for k in range(at, to):
                where[k] = starts[k] + response[starts[k] - begin : ends[k] - begin].argmax(axis=0)
        at = to
    return np.maximum(top + net.weights["start"], 0), where


def pooled(top: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest, least and mean chunk of each filter for each text, and the chunks that were largest and least; zeros for a text without bytes."""
    features = np.zeros((n, 3 * FILTERS), np.float32)
    most, least = np.full((n, FILTERS), -1, np.int64), np.full((n, FILTERS), -1, np.int64)
    rows = np.flatnonzero(of >= 0)
    bounds = np.searchsorted(of[rows], np.arange(n + 1))
    for i in range(n):
        own = rows[bounds[i] : bounds[i + 1]]
        if len(own):
            t = top[own]
            most[i], least[i] = own[t.argmax(axis=0)], own[t.argmin(axis=0)]
            features[i] = np.concatenate((t.max(axis=0), t.min(axis=0), t.mean(axis=0)))
    return features, most, least


def head(net: Network, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = net.weights
    z = features @ w["hidden"] + w["hidden_start"]
    hidden = np.maximum(z, LEAK * z)
    return hidden @ w["out"] + w["out_start"][0], hidden


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of the good label for whole texts."""
    if not texts:
        return np.zeros(0)
    symbols, starts, of = laid_out(texts)
    top, _ = chunk_maxima(net, symbols, starts)
    logit, _ = head(net, pooled(top, of, len(texts))[0])
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64) + net.shift, -700, 700)))


def gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss; the maxima pass theirs on to one window a chunk and filter."""
    w, n = net.weights, len(texts)
    symbols, starts, of = laid_out(texts)
    top, where = chunk_maxima(net, symbols, starts, places=True)
    features, most, least = pooled(top, of, n)
    logit, hidden = head(net, features)
    d_logit = ((1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels) / n).astype(np.float32)
    d_hidden = np.outer(d_logit, w["out"]) * np.where(hidden > 0, 1, LEAK).astype(np.float32)
    d_features = d_hidden @ w["hidden"].T
    d_top = np.zeros_like(top)
    each = np.arange(FILTERS)
    count = np.bincount(of[of >= 0], minlength=n)
    for i in np.flatnonzero(count):
        own = np.flatnonzero(of == i)
        d_top[own] += d_features[i, 2 * FILTERS :] / count[i]
        d_top[most[i], each] += d_features[i, :FILTERS]
        d_top[least[i], each] += d_features[i, FILTERS : 2 * FILTERS]
    d_top *= top > 0
    chunk, filters = np.nonzero(d_top)
    flow = d_top[chunk, filters]
    begin = where[chunk, filters]
    symbol = np.concatenate((symbols, np.full(WIDTH, PAD, np.uint16)))[begin[:, None] + np.arange(WIDTH)]
    seen = w["bytes"][symbol].reshape(len(begin), WIDTH * EMBED)
    d_filters = np.zeros_like(w["filters"])
    for f in each:
        mine = filters == f
        d_filters[:, f] = seen[mine].T @ flow[mine]
    back = (w["filters"].T[filters] * flow[:, None]).reshape(-1, EMBED)
    order = np.argsort(symbol.ravel(), kind="stable")
    d_bytes = np.zeros_like(w["bytes"])
    if len(order):
        met, first = np.unique(symbol.ravel()[order], return_index=True)
        d_bytes[met] = np.add.reduceat(back[order], first, axis=0)
    return {
        "bytes": d_bytes, "filters": d_filters, "start": d_top.sum(axis=0), "hidden": features.T @ d_hidden,
        "hidden_start": d_hidden.sum(axis=0), "out": hidden.T @ d_logit, "out_start": d_logit.sum(keepdims=True),
    }


def train(texts: list[bytes], labels: np.ndarray, turns: int = TURNS, rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam over so many batches, each label's texts in shuffled rounds; the rate falls to zero along the way."""
    net, draw = Network.drawn(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    kinds = [np.flatnonzero(labels == y) for y in (0, 1)]
    queues = [np.zeros(0, np.int64)] * 2
    for turn in range(1, turns + 1):
        some = []
        for y, own in enumerate(kinds):
            while len(queues[y]) < BATCH // 2:
                queues[y] = np.concatenate((queues[y], draw.permutation(own)))
            some.append(queues[y][: BATCH // 2])
            queues[y] = queues[y][BATCH // 2 :]
        batch = np.concatenate(some)
        now = rate * (1 - turn / (turns + 1))
        for k, g in gradients(net, [texts[i] for i in batch], labels[batch]).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.weights[k] -= (now * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo 5, is 0. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Network:
    """Fit on at most ``rows`` texts of each label (1 good, 0 bad), those of least id hash, none of them held out.

    Every labelled document is counted for the share of good ones. Texts over ``most_bytes`` bytes
    are not fitted on. Without labelled texts of both kinds every score is the smoothed share of good ones.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).alias("size")).join(own.where(~held_out(F.col("id"))), "id")
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    good, bad = share.get(1, 0), share.get(0, 0)
    picked: list[tuple] = []
    for y in (0, 1):  # at most 2 * rows ids
        fit_rows = known.where((F.col("y") == y) & (F.col("size") <= most_bytes)).select("id", "y").distinct()
        picked += fit_rows.orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    prior = math.log((good + 1) / (bad + 1))
    if len({r["y"] for r in picked}) < 2:
        net = Network.drawn()
        net.weights["out"] *= 0
        net.shift = prior
        return net
    kind = known.schema["id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(picked, f"id {kind}, y int")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")).where(F.length("t") <= most_bytes)
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("t").alias("t"))  # an id that repeats gives one text

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task over the bounded sample, as workers keep linear algebra to their own core."""
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        net = train([r[2] for r in rows], np.array([r[1] for r in rows], np.float32))
        out = [(k, list(v.shape), v.tobytes()) for k, v in net.weights.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["name", "shape", "weights"])

    learned = one.select("id", "y", "t").repartition(1).mapInArrow(learn, "name string, shape array<long>, weights binary").collect()
    return Network({r["name"]: np.frombuffer(bytes(r["weights"]), np.float32).reshape(r["shape"]) for r in learned}, prior)


def quality(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` and ``score``, the probability (0 to 1) that a text is of good quality.

    Null and empty texts get one same score, that of a text without bytes. Each row is scored by
    its own text, whatever its id or other columns; no rows give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def setup() -> Callable[[list[str]], dict[str, pa.Array]]:
        net = held.value
        return lambda texts: {"score": pa.array(scores(net, [t.encode() for t in texts]))}

    return map_rows(docs, list(keep), text_col, setup, "score double")


def judged(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the registered query."""
    return scored.select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
