"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that ends its valid
encoding. Storing that last token a prefix gives the encoding of any prefix by
walking back, makes an append cost only the new bytes, and lets a re-encoding
after an edit keep everything before it. A candidate token is valid when the last
token of the rest and the candidate would not be merged differently; that test
undoes the merges of the two tokens along their seam. Many pieces are treated
together, a byte of each at a time: an Aho-Corasick automaton over all tokens names
the candidates that end there, longest first.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._common import bounded, map_rows, sha, worker_state

#: Pieces whose ids a worker remembers; beyond it those not met lately are forgotten.
CACHE = 200_000
#: Pieces encoded together at most; fewer than FEW that are still unfinished are done one by one. Bits of a slot in the memory of pairs.
TOGETHER, FEW, PAIR_BITS = 1 << 16, 8, 20


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], remember: int = CACHE) -> None:
        self.ranks = ranks
        self.remember = remember
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.size = {i: len(b) for b, i in ranks.items()}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        # A token that its own bytes are not merged into can never be the last one.
        for token, raw in self.bytes_of.items():
            if len(raw) > 1 and self.parts(token) is None:
                del ranks[raw]
        self.order = np.array(sorted(self.bytes_of), np.int64)
        self.held = pa.array([self.bytes_of[i] for i in self.order.tolist()], pa.binary())

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens of which the merge rules make this one; None for a byte."""
        if token not in self.split:
            raw = self.bytes_of[token]
            pair = None
            if len(raw) > 1:
                pieces = [self.ranks[raw[i : i + 1]] for i in range(len(raw))]
                while len(pieces) > 2:
                    best = min(
                        (
                            (r, i)
                            for i in range(len(pieces) - 1)
                            if (r := self.ranks.get(self.bytes_of[pieces[i]] + self.bytes_of[pieces[i + 1]])) is not None
                            and r < token
                        ),
                        default=None,
                    )
                    if best is None:
                        break
                    pieces[best[1] : best[1] + 2] = [best[0]]
                pair = (pieces[0], pieces[1]) if len(pieces) == 2 else None
            self.split[token] = pair
        return self.split[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether left followed by right stays these two tokens."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > self.remember:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = 1 << 60
        a, b = left, right
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < limit:
                return False
            # Undo the later of the two merges that touch the seam.
            if a > b:
                limit = a
                pair = self.parts(a)
                if pair is None:
                    limit = b + 1
                    pair = self.parts(b)
                    if pair is None:
                        return True
                    b = pair[0]
                else:
                    a = pair[1]
            else:
                limit = b + 1
                pair = self.parts(b)
                if pair is None:
                    limit = a
                    pair = self.parts(a)
                    if pair is None:
                        return True
                    a = pair[1]
                else:
                    b = pair[0]


def extend(v: Vocabulary, raw: bytes, last: list[int]) -> None:
    """Store the last token of each prefix of ``raw`` that ``last`` does not reach yet."""
    ranks, fits, longest = v.ranks.get, v.fits, v.longest
    for end in range(len(last) + 1, len(raw) + 1):
        for start in range(end - longest if end > longest else 0, end):
            token = ranks(raw[start:end])
            if token is None:
                continue
            if start:
                key = (last[start - 1], token)
                fit = fits.get(key)
                if fit is None:
                    fit = v.compatible(*key)
                if not fit:
                    continue
            last.append(token)
            break
        else:
            raise ValueError("the vocabulary lacks a byte")


def walk(v: Vocabulary, last: list[int], at: int) -> list[int]:
    """The encoding of the first ``at`` bytes, from the stored last tokens."""
    out, size = [], v.size
    while at:
        token = last[at - 1]
        out.append(token)
        at -= size[token]
    out.reverse()
    return out


class Automaton:
    """The tokens' trie with the longest proper suffix of each state, as arrays; states are numbered by length, the root is 0.

    A state without children shares the row of transitions of its suffix. ``ends`` is the longest
    token (by its state) that ends in a state, ``after`` the next shorter one; 0 is none.
    """

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        raws = list(v.ranks)
        length = np.array([len(x) for x in raws])
        flat, start = np.frombuffer(b"".join(raws), np.uint8), np.cumsum(length) - length
        state, levels, count = np.zeros(len(raws), np.int64), [], 1
        for depth in range(v.longest):
            more = np.flatnonzero(length > depth)
            edges, at = np.unique(state[more] << 8 | flat[start[more] + depth], return_inverse=True)
            state[more] = count + at
            levels.append((edges >> 8, edges & 255, np.arange(count, count + len(edges))))
            count += len(edges)
        self.token, self.size = np.full(count, -1, np.int64), np.zeros(count, np.int64)
        self.token[state], self.size[state] = list(v.ranks.values()), length
        inner = np.zeros(count, bool)
        for parents, _, _ in levels:
            inner[parents] = True
        self.row, fail, self.ends = np.cumsum(inner) - 1, np.zeros(count, np.int64), np.zeros(count, np.int64)
        self.go = np.zeros((int(inner.sum()), 256), np.int32)
        for parents, byte, states in levels:
            if parents[0]:  # a suffix of the root's children is the root
                fail[states] = self.go[self.row[fail[parents]], byte]
            self.go[self.row[parents], byte] = states
            has = inner[states]
            self.go[self.row[states[has]]] = self.go[self.row[fail[states[has]]]]
            self.row[states[~has]] = self.row[fail[states[~has]]]
            self.ends[states] = np.where(self.token[states] >= 0, states, self.ends[fail[states]])
        self.after = self.ends[fail]
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each left token followed by the right one stays these two; each slot remembers its last pair, with the answer as lowest bit."""
        pair = left * len(self.size) + right
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        held = self.pairs[slot]
        new = np.flatnonzero(held >> 1 != pair)
        if len(new):
            asked, at = np.unique(pair[new], return_inverse=True)
            lefts, rights = (self.token[x].tolist() for x in np.divmod(asked, len(self.size)))
            said = asked << 1 | np.fromiter(map(self.v._compatible, lefts, rights), bool, len(asked))
            held[new] = self.pairs[slot[new]] = said[at]
        return (held & 1).astype(bool)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        length = np.array([len(x) for x in pieces])
        flat, start = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        length, start = length[order], start[order]
        # Pieces that reach beyond each byte come first; ``last`` holds their last tokens, byte after byte.
        deep = int(length[FEW - 1]) if len(pieces) >= FEW else 0
        reach = np.searchsorted(-length, -np.arange(deep))
        base = np.cumsum(reach) - reach
        last, state = np.zeros(int(reach.sum()), np.int64), np.zeros(len(pieces), np.int64)
        for end in range(deep):
            n = int(reach[end])
            state = self.go[self.row[state[:n]], flat[start[:n] + end]]
            open_, token = np.arange(n), self.ends[state]
            while len(open_):
                if not token.all():
                    raise ValueError("the vocabulary lacks a byte")
                before = end - self.size[token]
                good = before < 0
                seam = np.flatnonzero(~good)
                good[seam] = self.fit(last[base[before[seam]] + open_[seam]], token[seam])
                last[base[end] + open_[good]] = token[good]
                open_, token = open_[~good], self.after[token[~good]]
        # Walk back from the ends of the pieces, in rounds of one token each.
        done = int(np.searchsorted(-length, -deep))
        live = np.arange(done, int(np.searchsorted(-length, 0)))
        at, count, rounds = length[live], np.zeros(len(pieces), np.int64), []
        while len(live):
            token = last[base[at - 1] + live]
            rounds.append((live, self.token[token]))
            count[live] += 1
            at = at - self.size[token]
            live, at = live[at > 0], at[at > 0]
        stop = np.cumsum(count)
        ids = np.zeros(int(count.sum()), "<u4")
        for i, (live, token) in enumerate(rounds):
            ids[stop[live] - 1 - i] = token
        packed, stops, out = ids.tobytes(), (stop * 4).tolist(), [b""] * len(pieces)
        for i, (where, a, b) in enumerate(zip(order.tolist(), [0, *stops], stops)):
            if i < done:
                known = self.token[last[base + i]].tolist()
                extend(self.v, pieces[where], known)
                out[where] = np.array(walk(self.v, known, len(pieces[where])), "<u4").tobytes()
            else:
                out[where] = packed[a:b]
        return out


class PrefixEncoder:
    """Encoding that grows by bytes; ``last[i]`` is the token that ends prefix i + 1."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        extend(self.v, bytes(self.data), self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Edit bytes start:end; prefixes before the edit keep their last token.

        After the new bytes the old last tokens come into force again as soon as
        a whole longest token's worth of them has come out the same.
        """
        tail, old = bytes(self.data[end:]), self.last[end:]
        del self.data[start:], self.last[start:]
        self.append(new)
        same = 0
        raw = bytes(self.data) + tail
        for i in range(len(tail)):
            self.data += tail[i : i + 1]
            extend(self.v, raw[: len(self.data)], self.last)
            same = same + 1 if self.last[-1] == old[i] and len(self.v.bytes_of[old[i]]) <= i + 1 else 0
            if same >= self.v.longest:
                self.data += tail[i + 1 :]
                self.last += old[i + 1 :]
                return

    def ids(self) -> list[int]:
        return walk(self.v, self.last, len(self.data))


def vocabulary(path: str, remember: int = CACHE) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, remember)


class Encoder:
    """Whole texts: pieces by the pattern, each encoded once while remembered.

    The memory has two halves: when the newer one is full the older one goes,
    without the pieces that were met meanwhile.
    """

    def __init__(self, path: str, pattern: str, remember: int = CACHE) -> None:
        self.v = vocabulary(path, remember)
        self.automaton = Automaton(self.v)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), TOGETHER):
            some = pieces[i : i + TOGETHER]
            self.known |= zip(some, self.automaton.encode([p.encode("utf-8", "surrogatepass") for p in some]))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 256):
            split = [self.pattern.findall(t, concurrent=False) for t in texts[i : i + 256]]
            if 2 * len(self.known) >= self.v.remember:
                self.known, self.older = {}, self.known
            known, older = self.known, self.older
            new = {p for pieces in split for p in pieces if p not in known}
            known |= {p: older[p] for p in new & older.keys()}
            self.learn([p for p in new if p not in known])
            out += [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


def worker_encoder(path: str, pattern: str, remember: int = CACHE) -> Encoder:
    """One encoder a Python worker, so that its memory of pieces outlives a task; it goes when another operator runs there."""
    state = worker_state(__name__)
    key = (path, pattern, remember)
    if state.get("encoder") != key:
        state["encoder"], state["made"] = key, Encoder(*key)
    return state["made"]


def encode(
    df: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    decoded: bool = False,
    remember: int = CACHE,
) -> DataFrame:
    """Token ids of every whole text, in column ``ids`` as little-endian 32-bit integers.

    ``path`` is a rank file, readable where the tasks run. With ``decoded`` the ids
    are decoded again in the same pass, into column ``bytes``. A worker holds the ids of about
    ``remember`` pieces; fewer take less memory and more time, and give the same ids. Null and empty texts
    have no tokens; null ids and repeated rows are kept, an empty table gives none;
    other columns than ``id_col``, ``text_col`` and ``keep`` are not read.
    """

    def setup():  # noqa: ANN202
        encoder = worker_encoder(path, pattern, remember)

        def work(texts: list[str]) -> dict[str, pa.Array]:
            made = {"ids": pa.array(encoder.encode_batch(texts), pa.binary())}
            return made | {"bytes": bytes_of(encoder.v, made["ids"])} if decoded else made

        return work

    return map_rows(df, [id_col, *keep], text_col, setup, "ids binary, bytes binary" if decoded else "ids binary")


def bytes_of(v: Vocabulary, ids: pa.Array) -> pa.Array:
    """The bytes that each row's packed ids stand for; none for null."""
    rows = pc.fill_null(ids.cast(pa.binary()), b"")
    ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, np.int32)
    if ((ends - ends[0]) % 4).any():
        raise ValueError("ids are of four bytes each")
    flat = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u4")
    at = np.minimum(np.searchsorted(v.order, flat), len(v.order) - 1) if v.order[-1] >= len(v.order) else np.minimum(flat, len(v.order) - 1)
    if (v.order[at] != flat).any():
        raise KeyError("an id is not in the vocabulary")
    made = v.held.take(pa.array(at))
    starts = np.frombuffer(made.buffers()[1], np.int32)[made.offset :] if len(made) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(starts[(ends - ends[0]) // 4]), made.buffers()[2]])


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """Bytes of every row's ids, in column ``bytes``, beside ``ids_col`` and ``keep``; null ids give no bytes."""
    source = df.select(id_col, *keep, ids_col)
    held = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in (id_col, *keep))

    def run(batches):  # noqa: ANN001, ANN202
        state = worker_state(__name__)
        if state.get("vocabulary") != path:
            state["vocabulary"], state["read"] = path, vocabulary(path)
        for batch in bounded(batches, len(keep) + 1):
            made = bytes_of(state["read"], batch.column(len(keep) + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[id_col, *keep, ids_col, "bytes"])

    return source.mapInArrow(run, f"{held}, `{ids_col}` binary, bytes binary")


def digest(decoded: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    return decoded.select(
        id_col,
        *keep,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        sha(F.col("ids")).alias("ids_sha256"),
        sha(F.col("bytes")).alias("decoded_sha256"),
    )
