"""Suffix-array dedup: repeated byte strings across documents.

A byte goes when a string of ``length`` bytes that covers it also starts in a
document with a smaller id. The work is that of a suffix array cut off at
``length``, built bucket by bucket:

1. Every start of a string is given to its anchor, the 24-byte gram of least hash
   inside the string. Equal strings have the same anchor at the same place, so a
   bucket of anchors holds all copies of its strings. One pass finds the anchors
   that occur in two documents; no other suffix can repeat.
2. The suffixes of those anchors, as snippets of text with equal snippets merged,
   are dealt to buckets by anchor. An anchor found in very many blocks is hot; its
   suffixes are dealt one by one by their own bytes instead.
3. A bucket is sorted one leading-byte range at a time. Ties of the first sixteen
   bytes are resolved by the precomputed ranks of a difference-cover sample: two
   suffixes are compared at the shift that puts both in the sample. Neighbours in
   the order that agree in all ``length`` bytes form a class, and its smallest
   document keeps the string.

Documents are shuffled once, by block; the three passes over blocks reuse it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._common import total_bytes

LENGTH = 50
GRAM = 24  # long enough that ordinary phrases do not make an anchor repeat
BLOCK_BYTES = 16 << 20  # text of a block: copies inside one are sent on once
BUCKET_BYTES = 2 << 20  # text of the share that a bucket answers for
LEAST_BLOCKS = 64
PIECE = 1 << 20  # bytes whose anchors are found at once; under 2**24
HOT_BLOCKS = 200  # blocks from which on an anchor is hot
SORT_AT_ONCE = 1 << 18  # suffixes of a leading-byte range
COVERS = {3: (0, 1), 7: (0, 1, 3)}  # difference covers; shifts stay within the bytes sorted first

U64 = np.uint64
NO_ID = 2**63 - 1  # stands for a null id


def words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes at each position, as one number."""
    return np.ndarray(shape=(max(0, len(data) - 7),), dtype=f"{order}u8", buffer=data, strides=(1,))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def find_anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the starts in ``data``, texts put together that end at ``ends``.

    Returns, of each run of starts with one anchor: the first start, the number of
    starts, the anchor's place and its hash.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    if len(data) < length:
        return none
    w = words(data)
    h = w[: len(data) - GRAM + 1] * U64(0x9E3779B97F4A7C15)
    for i in range(8, GRAM - 7, 8):
        h = mix(h) ^ (w[i : len(data) - GRAM + 1 + i] * U64(0xC2B2AE3D27D4EB4F))
    h = mix(h)
    low = U64((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=U64)
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    inside = np.ones(len(key), bool)  # starts whose string stays in its text
    for end in ends[:-1]:
        inside[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(inside[: len(data) - length + 1])
    if not len(starts):
        return none
    place = (key[starts] & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))))
    count = np.diff(np.append(cut, len(starts)))
    place = place[cut]
    return starts[cut], count, place, h[place]


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress each text for the one shuffle of all texts; ``n`` is its length."""
    for batch in batches:
        raw = [x.as_py() or b"" for x in batch.column(4)]
        text = pa.array([pa.compress(x, codec="zstd", asbytes=True) if x else b"" for x in raw], pa.binary())
        n = pa.array([len(x) for x in raw], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], text, n], names=[*batch.schema.names[:4], "text", "n"])


def texts_of(table: pa.Table) -> Iterator[bytes]:
    for text, n in zip(table.column("text"), table.column("n"), strict=True):
        yield pa.decompress(text.as_py(), n.as_py(), codec="zstd", asbytes=True) if n.as_py() else b""


def pieces(table: pa.Table, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a block in bounded parts: bytes, ends, and of each its row and offset."""
    held: list[bytes] = []
    rows: list[int] = []
    offs: list[int] = []
    size = 0

    def out():  # noqa: ANN202
        return (
            np.frombuffer(b"".join(held), np.uint8),
            np.cumsum([len(x) for x in held]),
            np.array(rows),
            np.array(offs),
        )

    for row, raw in enumerate(texts_of(table)):
        for at in range(0, max(1, len(raw) - length + 1), PIECE):
            held.append(raw[at : at + PIECE + length - 1])
            rows.append(row)
            offs.append(at)
            size += len(held[-1])
            if size >= PIECE:
                yield out()
                held, rows, offs, size = [], [], [], 0
    if held:
        yield out()


def in_order(table: pa.Table) -> pa.Table:
    """Rows of a block by id and text hash: equal rows are alike, so a number names a row."""
    return table.combine_chunks().sort_by([("doc", "ascending"), ("rid", "ascending")])


def bucket_of(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> U64(32)) % U64(buckets), (h & U64(0xFFFFFFFF)).astype(np.uint32)


def block_anchors(table: pa.Table, buckets: int, length: int) -> pa.Table:
    """The distinct anchors of a block, packed by bucket; flagged if two documents of it share one."""
    table = in_order(table)
    docs = table.column("doc").to_numpy()
    hs, of = [], []
    for data, ends, rows, _ in pieces(table, length):
        starts, _, _, h = find_anchors(data, ends, length)
        hs.append(h)
        of.append(docs[rows[np.searchsorted(ends, starts, side="right")]] if len(starts) else np.zeros(0, np.int64))
    h, of = np.concatenate(hs), np.concatenate(of)
    order = np.lexsort((of, h))
    h, of = h[order], of[order]
    first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    cut = np.flatnonzero(first)
    shared = np.zeros(len(cut), bool)
    if len(cut):
        shared = of[cut] != of[np.append(cut[1:], len(h)) - 1]
    bucket, rest = bucket_of(h[cut], buckets)
    order = np.lexsort((rest, bucket))
    bucket, rest, shared = bucket[order], rest[order], shared[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    ends = [*edges[1:], len(bucket)] if len(bucket) else []
    return pa.table(
        {
            "bucket": pa.array([int(bucket[a]) for a in edges], pa.int32()),
            "blk": pa.array([table.column("blk")[0].as_py()] * len(edges), pa.int32()),
            "hashes": pa.array([rest[a:b].tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary()),
            "shared": pa.array([np.packbits(shared[a:b]).tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary()),
        }
    )


def repeated_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket: to every block its anchors that other documents have too, hot ones apart."""
    parts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("hashes")]
    flags = [
        np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool)
        for x, p in zip(table.column("shared"), parts, strict=True)
    ]
    every = np.concatenate(parts)
    value, where, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.bincount(where, np.concatenate(flags), len(value)) > 0
    keep, hot = ((count > 1) | shared)[where], (count >= HOT_BLOCKS)[where]
    out: dict[str, list] = {"blk": [], "kept": [], "hot": []}
    at = 0
    for blk, part in zip(table.column("blk").to_pylist(), parts, strict=True):
        k, t = keep[at : at + len(part)], hot[at : at + len(part)]
        at += len(part)
        if k.any():
            out["blk"].append(blk)
            out["kept"].append(part[k & ~t].tobytes())
            out["hot"].append(part[t].tobytes())
    bucket = table.column("bucket")[0].as_py()
    return pa.table(
        {
            "blk": pa.array(out["blk"], pa.int32()),
            "bucket": pa.array([bucket] * len(out["blk"]), pa.int32()),
            "kept": pa.array(out["kept"], pa.binary()),
            "hot": pa.array(out["hot"], pa.binary()),
        }
    )


def joined(table: pa.Table, column: str) -> np.ndarray:
    """Bucket and rest of the anchors that a block has back, as sorted numbers."""
    rows = zip(table.column("bucket").to_pylist(), table.column(column).to_pylist(), strict=True)
    found = [np.frombuffer(x, np.uint32).astype(U64) | (U64(b) << U64(32)) for b, x in rows]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, U64)


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.searchsorted(among, x)
    at[at == len(among)] = 0
    return among[at] == x


def snippets_of(table: pa.Table, back: pa.Table, buckets: int, length: int) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Of a block in order, bucket by bucket: distinct snippets of repeated anchors, and of each place its snippet, row and position."""
    if not table.num_rows or not back.num_rows:
        return
    kept, hot = joined(back, "kept"), joined(back, "hot")
    texts: list[bytes] = []
    buckets_of, in_rows, places = [], [], []
    for data, ends, rows, offs in pieces(table, length):
        first, count, _, h = find_anchors(data, ends, length)
        bucket, rest = bucket_of(h, buckets)
        number = (bucket << U64(32)) | rest.astype(U64)
        warm, burning = member(number, kept), member(number, hot)
        # A hot anchor's starts become snippets of their own, dealt by their bytes.
        single = np.repeat(first[burning], count[burning])
        single += np.arange(len(single)) - np.repeat(np.cumsum(count[burning]) - count[burning], count[burning])
        text = data.tobytes()
        alone = [text[a : a + length] for a in single.tolist()]
        dealt = [int.from_bytes(hashlib.blake2b(x, digest_size=6).digest(), "little") % buckets for x in alone]
        stop = (first + count + length - 1)[warm]
        texts += [text[a:b] for a, b in zip(first[warm].tolist(), stop.tolist(), strict=True)] + alone
        buckets_of += [bucket[warm].astype(np.int64), np.array(dealt, np.int64)]
        first = np.concatenate((first[warm], single))
        which = np.searchsorted(ends, first, side="right")
        in_rows.append(rows[which])
        places.append(first - np.concatenate(([0], ends[:-1]))[which] + offs[which])
    if not texts:
        return
    bucket, row, pos = map(np.concatenate, (buckets_of, in_rows, places))
    order = np.argsort(bucket, kind="stable")
    bucket, row, pos = bucket[order], row[order], pos[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist()
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
        known: dict[bytes, int] = {}
        of = np.array([known.setdefault(texts[i], len(known)) for i in order[a:b].tolist()], np.int64)
        yield int(bucket[a]), list(known), of, row[a:b], pos[a:b]


def block_snippets(table: pa.Table, back: pa.Table, buckets: int, length: int) -> pa.Table:
    """By bucket the distinct snippets of a block, with the least and greatest document of each.

    Places stay with their block, so a string in every document is one row a block.
    """
    names = ("bucket", "blk", "snippets", "size", "packed")
    kinds = (*[pa.int32()] * 3, pa.int64(), pa.binary())
    cols: dict[str, list] = {n: [] for n in names}
    if table.num_rows:
        table = in_order(table)
        docs, blk = table.column("doc").to_numpy(), table.column("blk")[0].as_py()
    for bucket, known, of, row, _ in snippets_of(table, back, buckets, length):
        least, most = np.full(len(known), NO_ID), np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(least, of, docs[row])
        named = docs[row] != NO_ID
        np.maximum.at(most, of[named], docs[row][named])
        sizes = np.array([len(x) for x in known], "<u4").tobytes()
        raw = b"".join([sizes, least.astype("<i8").tobytes(), most.astype("<i8").tobytes(), *known])
        for n, value in zip(names, (bucket, blk, len(known), len(raw), pa.compress(raw, codec="zstd", asbytes=True)), strict=True):
            cols[n].append(value)
    return pa.table({n: pa.array(cols[n], k) for n, k in zip(names, kinds, strict=True)})


def shifts(v: int) -> np.ndarray:
    """Of two residues the least shift that takes both into the difference cover."""
    cover = set(COVERS[v])
    return np.array(
        [[next(d for d in range(v) if (a + d) % v in cover and (b + d) % v in cover) for b in range(v)] for a in range(v)]
    )


class Cover:
    """Ranks of a difference-cover sample of a bucket's text, made before any of its ranges is sorted.

    Only suffixes that share their first sixteen bytes with another can tie, so the sample
    is that of their neighbourhoods. ``text`` ends in at least length + v + 16 bytes of padding.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, v: int, length: int) -> None:
        self.v, self.shift = v, shifts(v)
        w = words(text, ">")
        first = mix(w[starts] * U64(0x9E3779B97F4A7C15)) ^ w[starts + 8]
        order = np.argsort(first, kind="stable")
        again = first[order][1:] == first[order][:-1]
        tied = np.zeros(len(starts), bool)
        tied[order[1:][again]] = tied[order[:-1][again]] = True  # a clash of hashes only adds to the sample
        near = starts[tied]
        at = np.unique(np.concatenate([(near + d)[np.isin((near + d) % v, COVERS[v])] for d in range(self.shift.max() + 1)]))
        keys = [w[at + i].astype(U64) for i in [*range(0, length - 7, 8), *[length - 8] * (length % 8 > 0)]]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        self.at, self.ranks = at, np.empty(len(at), np.int64)
        self.ranks[order] = np.cumsum(new) + 1

    def rank(self, x: np.ndarray) -> np.ndarray:
        return self.ranks[np.searchsorted(self.at, x)]


def same_strings(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    w = words(text)
    equal = np.ones(len(a), bool)
    for i in [*range(0, length - 7, 8), length - 8]:
        equal &= w[a + i] == w[b + i]
    return equal


def tied_groups(starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(group)[group] > 1)


def prefix_order(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` by their first 16 bytes, and the number of each one's group of equals."""
    w = words(text, ">")
    key = w[starts].astype(U64)
    order = np.argsort(key, kind="stable")
    starts, key = starts[order], key[order]
    group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    tied = tied_groups(starts, group)
    if not len(tied):
        return starts, group
    after = w[starts[tied] + 8].astype(U64)
    order = np.lexsort((after, group[tied]))
    starts[tied] = starts[tied][order]
    split = np.zeros(len(starts), bool)
    split[tied[1:]] = after[order][1:] != after[order][:-1]
    return starts, np.cumsum(np.concatenate(([False], group[1:] != group[:-1])) | split)


def sort_range(text: np.ndarray, starts: np.ndarray, cover: Cover) -> np.ndarray:
    """``starts`` in suffix order: 16 bytes first, longer ties by the ranks of the cover sample."""
    starts, group = prefix_order(text, starts)
    tied = tied_groups(starts, group)
    if not len(tied):
        return starts
    v, shift = cover.v, cover.shift
    at, g = starts[tied], group[tied]
    residue = at % v
    width = len(cover.at) + 2
    below = np.zeros(len(at), np.int64)  # suffixes of its group that come before each
    for b in range(v):
        other = np.flatnonzero(residue == b)
        if not len(other):
            continue
        for a in range(v):
            mine = np.flatnonzero(residue == a)
            if not len(mine):
                continue
            d = shift[a, b]
            theirs = np.sort(g[other] * width + cover.rank(at[other] + d))
            base = g[mine] * width
            below[mine] += np.searchsorted(theirs, base + cover.rank(at[mine] + d)) - np.searchsorted(theirs, base)
    starts[tied] = at[np.lexsort((below, g))]
    return starts


def sorted_classes(text: np.ndarray, starts: np.ndarray, v: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One leading-byte range after the other: its starts in suffix order and their classes."""
    cover = Cover(text, starts, v, length)
    lead = text[starts]
    by_lead = starts[np.argsort(lead, kind="stable")]
    counts = np.bincount(lead, minlength=256)
    begin = end = 0
    for n in [*counts.tolist(), None]:
        if n is None or (end > begin and end + n - begin > SORT_AT_ONCE):
            if end > begin:
                part = sort_range(text, by_lead[begin:end], cover)
                new = np.concatenate(([True], ~same_strings(text, part[1:], part[:-1], length)))
                yield part, np.cumsum(new) - 1
            begin = end
        end += n or 0


def bucket_repeats(table: pa.Table, v: int, length: int) -> pa.Table:
    """Of one bucket, for each block: the runs of starts in its snippets that a smaller document has, and which document."""
    known: dict[bytes, int] = {}
    of, least_of, most_of, of_block = [], [], [], []
    for k, r in enumerate(table.to_pylist()):
        n = r["snippets"]
        raw, at = pa.decompress(r["packed"], r["size"], codec="zstd", asbytes=True), 20 * n
        least_of.append(np.frombuffer(raw, "<i8", n, 4 * n))
        most_of.append(np.frombuffer(raw, "<i8", n, 12 * n))
        own = []
        for size in np.frombuffer(raw, "<u4", n).tolist():
            own.append(known.setdefault(raw[at : at + size], len(known)))
            at += size
        of.append(np.array(own))
        of_block.append(np.full(n, k))
    of, least_doc, most_doc, of_block = map(np.concatenate, (of, least_of, most_of, of_block))
    size = np.array([len(s) for s in known])
    n_starts = size - length + 1
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"".join([*known, bytes(length + v + 16)]), np.uint8)
    smallest = np.full(len(size), NO_ID)
    np.minimum.at(smallest, of, least_doc)
    flat = np.cumsum(n_starts) - n_starts  # of each snippet its first start among all starts
    owner = np.repeat(np.arange(len(size)), n_starts)
    starts = begin[owner] + np.arange(len(owner)) - flat[owner]
    number = np.zeros(len(text), np.int64)
    number[starts] = np.arange(len(starts))
    least = np.empty(len(starts), np.int64)
    for part, cls in sorted_classes(text, starts, v, length):
        which = number[part]
        found = np.full(cls[-1] + 1, NO_ID)
        np.minimum.at(found, cls, smallest[owner[which]])
        least[which] = found[cls]
    # Runs of starts with one least document, then those of each block's snippets that a place of it may lose.
    first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))))
    run = {"snippet": owner[first], "off": first - flat[owner[first]], "n": np.diff(np.append(first, len(least))), "least": least[first]}
    runs_of = np.bincount(run["snippet"], minlength=len(size))
    before = np.cumsum(runs_of) - runs_of
    reps = runs_of[of]
    item = np.repeat(np.arange(len(of)), reps)
    which = before[of[item]] + np.arange(len(item)) - np.repeat(np.cumsum(reps) - reps, reps)
    lost = run["least"][which] < most_doc[item]
    item, which = item[lost], which[lost]
    blk, per = table.column("blk").to_pylist(), np.bincount(of_block, minlength=table.num_rows)
    own = item - (np.cumsum(per) - per)[of_block[item]]  # the number of the snippet in its block's list
    cols: dict[str, list] = {n: [] for n in ("blk", "bucket", "runs")}
    ends = np.searchsorted(of_block[item], np.arange(table.num_rows + 1))
    for k in range(table.num_rows):
        a, b = ends[k], ends[k + 1]
        if a == b:
            continue
        cols["blk"].append(blk[k])
        cols["bucket"].append(table.column("bucket")[0].as_py())
        picked = which[a:b]
        cols["runs"].append(np.column_stack([own[a:b], run["off"][picked], run["n"][picked], run["least"][picked]]).astype("<i8").tobytes())
    none = pa.array([None] * len(cols["blk"]), pa.binary())
    return pa.table(
        {"blk": pa.array(cols["blk"], pa.int32()), "bucket": pa.array(cols["bucket"], pa.int32()), "kept": none, "hot": none, "runs": pa.array(cols["runs"], pa.binary())}
    )


RESULT = [("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]


def repeated_starts(table: pa.Table, found: pa.Table, buckets: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block in order: row, first start and number of starts of each run that goes.

    ``found`` has the block's repeated anchors and, by bucket, its runs; its snippets are
    cut again in the same order, which tells the places of each.
    """
    is_run = pc.is_valid(found.column("runs"))
    rows = found.filter(is_run)
    by_bucket = dict(zip(rows.column("bucket").to_pylist(), rows.column("runs").to_pylist(), strict=True))
    out: list[tuple[np.ndarray, ...]] = []
    docs = table.column("doc").to_numpy()
    for bucket, _, of, row, pos in snippets_of(table, found.filter(pc.invert(is_run)), buckets, length) if by_bucket else ():
        if bucket not in by_bucket:
            continue
        own, off, n, least = np.frombuffer(by_bucket[bucket], "<i8").reshape(-1, 4).T
        order = np.argsort(of, kind="stable")
        count = np.bincount(of, minlength=int(max(of.max(), own.max())) + 1)
        begin = np.cumsum(count) - count
        reps = count[own]
        k = np.repeat(np.arange(len(own)), reps)
        place = order[begin[own[k]] + np.arange(len(k)) - np.repeat(np.cumsum(reps) - reps, reps)]
        doc = docs[row[place]]
        gone = (least[k] < doc) & (doc != NO_ID)
        place, k = place[gone], k[gone]
        out.append((row[place], pos[place] + off[k], n[k]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def cut_out(table: pa.Table, runs: tuple[np.ndarray, np.ndarray, np.ndarray], length: int) -> pa.Table:
    """Of a block's rows, in order: the removed byte spans and the bytes that are left."""
    row, start, n = runs
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + n + length - 1)[order]
    first = np.searchsorted(row, np.arange(table.num_rows + 1))
    removed, kept = [], []
    for i, raw in enumerate(texts_of(table)):
        spans: list[list[int]] = []
        for a, b in zip(start[first[i] : first[i + 1]].tolist(), end[first[i] : first[i + 1]].tolist(), strict=True):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        out, at = [], 0
        for a, b in spans:
            out.append(raw[at:a])
            at = b
        kept.append(b"".join([*out, raw[at:]]))
        removed.append([{"start": a, "end": b} for a, b in spans])
    return pa.table(
        {"id": table.column("id"), "removed": pa.array(removed, RESULT[0][1]), "kept": pa.array(kept, pa.binary())}
    )


def dedup_substrings(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, v: int = 3, digest_only: bool = False
) -> DataFrame:
    """Remove repeated strings of ``length`` bytes (at least 32) from every whole text.

    Returns ``id_col``, ``removed`` (maximal byte spans) and ``kept`` (the bytes
    left); with ``digest_only`` the columns n_bytes, n_removed, n_spans and
    kept_sha256 instead. Ids are integers. Strings are judged on the input. Null
    texts are empty; texts under ``length`` bytes keep all; a row with a null id
    neither loses bytes nor takes them from others; rows of one id do not take from
    each other; an empty table gives no rows; other columns are not read.
    """
    size = total_bytes(df, text_col)
    parts, buckets = max(LEAST_BLOCKS, size // BLOCK_BYTES), max(LEAST_BLOCKS, size // BUCKET_BYTES)
    kind = df.schema[id_col].dataType.simpleString()
    rid = F.xxhash64(F.col(id_col), F.col(text_col))
    docs = df.select(
        F.col(id_col).alias("id"),
        # A null id counts as the largest, so no other loses bytes to it.
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        rid.alias("rid"),
        F.pmod(rid, F.lit(parts)).cast("int").alias("blk"),
        F.col(text_col).cast("binary").alias("text"),
    ).mapInArrow(squeeze, f"id {kind}, doc long, rid long, blk int, text binary, n int")
    blocks = docs.groupBy("blk")
    anchors = blocks.applyInArrow(
        lambda t: block_anchors(t, buckets, length), "bucket int, blk int, hashes binary, shared binary"
    )
    back = anchors.groupBy("bucket").applyInArrow(repeated_anchors, "blk int, bucket int, kept binary, hot binary")
    snippets = blocks.cogroup(back.groupBy("blk")).applyInArrow(
        lambda t, b: block_snippets(t, b, buckets, length),
        "bucket int, blk int, snippets int, size long, packed binary",
    )
    runs = snippets.groupBy("bucket").applyInArrow(
        lambda t: bucket_repeats(t, v, length), "blk int, bucket int, kept binary, hot binary, runs binary"
    )
    found = runs.unionByName(back.withColumn("runs", F.lit(None).cast("binary")))

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        if table.num_rows:
            table = in_order(table)
        done = cut_out(table, repeated_starts(table, found, buckets, length), length)
        if not digest_only:
            return done.rename_columns([id_col, "removed", "kept"])
        kept = done.column("kept").to_pylist()
        spans = done.column("removed").to_pylist()
        removed = [sum(s["end"] - s["start"] for s in x) for x in spans]
        return pa.table(
            {
                id_col: done.column("id"),
                "n_bytes": pa.array([len(k) + r for k, r in zip(kept, removed, strict=True)], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array([len(x) for x in spans], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            }
        )

    shown = (
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        if digest_only
        else "removed array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return blocks.cogroup(found.groupBy("blk")).applyInArrow(finish, f"`{id_col}` {kind}, {shown}")
