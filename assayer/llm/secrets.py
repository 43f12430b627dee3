"""Secret scan: probabilistic automata inferred from labelled credentials.

The base patterns find assignments, access keys and long hexadecimal runs. The
method adds spans of kind ``inferred``: a prefix tree of labelled credentials is
folded into a probabilistic deterministic automaton by merging states whose
outgoing frequencies are statistically compatible (Hoeffding bound); every
candidate token is scored by its log-likelihood under that automaton against one
inferred in the same way from ordinary tokens.
"""

from __future__ import annotations

import math
import random
import re
import string
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._common import SPANS_SQL, count_kind, joined_spans, map_rows, sha, spans_array

# Fixed values of the base patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Tokens that are scored.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[+/_.=-]*([A-Za-z0-9][A-Za-z0-9+/_.=-]{15,})")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SHORTEST = 16
BARE_SHORTEST = 24  # and upper and lower case, where no prefix tells a credential
CUTS = "=/."  # inside a run a credential may follow one of these and end before one
LITERAL = 4  # leading characters that the automaton reads as they are; later ones by class

UPPER_DIGITS = string.ascii_uppercase + "234567"
ALNUM = string.ascii_letters + string.digits
URL64 = ALNUM + "_-"
# Public credential formats as (prefix, alphabet, length) parts.
FORMATS = (
    (("AKIA", UPPER_DIGITS, 16),),
    (("ASIA", UPPER_DIGITS, 16),),
    (("ghp_", ALNUM, 36),),
    (("gho_", ALNUM, 36),),
    (("ghs_", ALNUM, 36),),
    (("glpat-", URL64, 20),),
    (("sk_live_", ALNUM, 24),),
    (("rk_live_", ALNUM, 24),),
    (("npm_", ALNUM, 36),),
    (("sq0atp-", URL64, 22),),
    (("AIza", URL64, 35),),
    (("xoxb-", string.digits, 12), ("-", string.digits, 12), ("-", ALNUM, 24)),
    (("xoxp-", string.digits, 12), ("-", string.digits, 12), ("-", ALNUM, 24)),
    (("eyJh", ALNUM, 32), (".eyJ", ALNUM, 60), (".", URL64, 43)),
)
# Credentials without a prefix, as (alphabet, length).
BARE = ((ALNUM + "+/", 40), (ALNUM, 32), (URL64, 43), (ALNUM, 24))


def kind_of(c: str) -> str:
    return "U" * c.isupper() or "l" * c.islower() or "9" * c.isdigit() or c


def symbols(token: str, literal: int = LITERAL) -> list[str]:
    """The automaton's input: four literal characters, then character classes."""
    return [*token[:literal], *map(kind_of, token[literal:])]


class Automaton:
    """Probabilistic deterministic automaton by state merging (ALERGIA)."""

    def __init__(self, tokens: list[list[str]], alpha: float = 0.05) -> None:
        self.alpha = alpha
        self.next: list[dict[str, int]] = [{}]
        self.flow: list[dict[str, int]] = [{}]
        self.seen = [0]
        self.ends = [0]
        self._tree(tokens)
        self._merge()
        self._keep_reachable()
        self._log()

    def _tree(self, tokens: list[list[str]]) -> None:
        for token in tokens:
            q = 0
            self.seen[q] += 1
            for s in token:
                if s not in self.next[q]:
                    self.next[q][s] = len(self.next)
                    self.next.append({})
                    self.flow.append({})
                    self.seen.append(0)
                    self.ends.append(0)
                self.flow[q][s] = self.flow[q].get(s, 0) + 1
                q = self.next[q][s]
                self.seen[q] += 1
            self.ends[q] += 1

    def _differ(self, a: int, na: int, b: int, nb: int) -> bool:
        if not na or not nb:
            return False
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
        return abs(a / na - b / nb) > bound

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if self._differ(self.ends[p], self.seen[p], self.ends[q], self.seen[q]):
                return False
            for s in self.flow[p].keys() | self.flow[q].keys():
                if self._differ(self.flow[p].get(s, 0), self.seen[p], self.flow[q].get(s, 0), self.seen[q]):
                    return False
                if s in self.next[p] and s in self.next[q] and self.next[p][s] != self.next[q][s]:
                    todo.append((self.next[p][s], self.next[q][s]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.seen[p] += self.seen[q]
            self.ends[p] += self.ends[q]
            for s, n in self.flow[q].items():
                self.flow[p][s] = self.flow[p].get(s, 0) + n
                if s in self.next[p]:
                    todo.append((self.next[p][s], self.next[q][s]))
                else:
                    self.next[p][s] = self.next[q][s]

    def _merge(self) -> None:
        """Each state next to the settled ones, most seen first, is merged into the nearest compatible one or settles."""
        red = [0]
        settled = {0}
        while True:
            blue = {(p, s): q for p in red for s, q in self.next[p].items() if q not in settled}
            if not blue:
                return
            (parent, s), q = max(blue.items(), key=lambda x: (self.seen[x[1]], -x[0][0], x[0][1]))
            # The newest settled state is the nearest in depth.
            for p in reversed(red):
                if self._compatible(p, q):
                    self.next[parent][s] = p
                    self._fold(p, q)
                    break
            else:
                red.append(q)
                settled.add(q)

    def _keep_reachable(self) -> None:
        order, number = [0], {0: 0}
        for q in order:
            for p in self.next[q].values():
                if p not in number:
                    number[p] = len(order)
                    order.append(p)
        self.next = [{s: number[p] for s, p in self.next[q].items()} for q in order]
        self.flow, self.seen, self.ends = ([x[q] for q in order] for x in (self.flow, self.seen, self.ends))

    def _log(self) -> None:
        size = len({s for f in self.flow for s in f}) + 1
        self.cost = [
            {s: math.log((n + 0.05) / (self.seen[q] + 0.05 * size)) for s, n in self.flow[q].items()}
            for q in range(len(self.next))
        ]
        self.other = [math.log(0.05 / (n + 0.05 * size)) for n in self.seen]
        self.stop = [math.log((e + 0.05) / (n + 0.05 * size)) for e, n in zip(self.ends, self.seen, strict=True)]

    def step(self, q: int, s: str) -> tuple[float, int]:
        """Log-likelihood of a symbol and the next state; after an unseen symbol the automaton stays in its state."""
        cost = self.cost[q].get(s)
        return (self.other[q], q) if cost is None else (cost, self.next[q][s])

    def score(self, token: list[str]) -> float:
        """Log-likelihood of a whole token."""
        q, total = 0, 0.0
        for s in token:
            cost, q = self.step(q, s)
            total += cost
        return total + self.stop[q]


def labelled_tokens(per_format: int = 60, seed: int = 7) -> tuple[list[str], list[str]]:
    """Credentials made by the public formats, and ordinary tokens of like length."""
    draw = random.Random(seed)
    pick = lambda chars, n: "".join(draw.choice(chars) for _ in range(n))
    secrets = ["".join(p + pick(a, n) for p, a, n in f) for f in FORMATS for _ in range(per_format)]
    word = lambda: pick(string.ascii_lowercase, draw.randint(3, 10))
    plain: list[str] = []
    for _ in range(per_format * 5):
        plain += [
            "-".join(word() for _ in range(draw.randint(3, 5))) + f"-{draw.randint(1, 9999)}",
            "_".join(word() for _ in range(draw.randint(3, 5))) + str(draw.randint(1, 99)),
            "/".join(word() for _ in range(draw.randint(3, 6))) + f"/{draw.randint(1, 999)}.html",
            f"20{draw.randint(10, 29)}-0{draw.randint(1, 9)}-{draw.randint(10, 28)}T10.{draw.randint(10, 59)}",
            pick(string.digits, draw.randint(16, 30)),
            "".join(word().title() for _ in range(3)) + str(draw.randint(1, 999)),
            "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
            word() + "." + word() + pick(string.digits, 2) + "." + word() + ".com",
            word() + word() + word() + pick(string.digits, 2),
            word().upper() + word().upper() + pick(string.digits, 4),
        ]
    return secrets, plain


def bare_tokens(per_format: int = 60, seed: int = 11) -> list[str]:
    """Credentials without a prefix."""
    draw = random.Random(seed)
    return ["".join(draw.choice(a) for _ in range(n)) for a, n in BARE for _ in range(per_format)]


@lru_cache(maxsize=1)
def automata() -> tuple[Automaton, ...]:
    """The automata of credentials and ordinary tokens, then by class alone those of credentials without a prefix and ordinary tokens."""
    secrets, plain = labelled_tokens()
    kinds = [(secrets, LITERAL), (plain, LITERAL), (bare_tokens(), 0), (plain, 0)]
    return tuple(Automaton([symbols(t, literal) for t in tokens]) for tokens, literal in kinds)


def likelihood_ratio(token: str, models: tuple[Automaton, ...]) -> float:
    """Nats a character by which a credential automaton explains a token better than the ordinary one of its kind."""
    secret, plain, bare, classes = models
    s, k = symbols(token), symbols(token, 0)
    best = secret.score(s) - plain.score(s)
    if len(s) >= BARE_SHORTEST and {"U", "l"} <= set(k):
        best = max(best, bare.score(k) - classes.score(k))
    return best / len(s)


def inner_secrets(run: str, threshold: float, models: tuple[Automaton, ...]) -> list[tuple[int, int, float]]:
    """Disjoint credentials that start and end at cuts of a run, the best first: start, end, score.

    All pairs of cuts are scored in one pass: of starts that have brought both
    automata to the same states only the best can be the best at any later end.
    """
    found = []
    for model, plain, literal, least in ((*models[:2], LITERAL, SHORTEST), (*models[2:], 0, BARE_SHORTEST)):
        live: list[tuple[float, int, int, int, bool, bool, bool]] = []
        for i, c in enumerate(run):
            kind = kind_of(c)
            if (not i or run[i - 1] in CUTS) and c.isalnum():
                live.append((0.0, i, 0, 0, False, False, False))
            after: dict[tuple, tuple[float, int, int, int, bool, bool, bool]] = {}
            for gain, s, q, p, upper, lower, digit in live:
                up, q = model.step(q, c if i - s < literal else kind)
                down, p = plain.step(p, c if i - s < literal else kind)
                one = (gain + up - down - threshold, s, q, p, upper or kind == "U", lower or kind == "l", digit or kind == "9")
                key = one[2:] if i - s + 1 >= least else (s,)
                if key not in after or after[key] < one:
                    after[key] = one
            live = list(after.values())
            if (i + 1 == len(run) or run[i + 1] in CUTS) and c not in ".=-/":
                ends = [
                    (g + model.stop[q] - plain.stop[p], s)
                    for g, s, q, p, u, l, d in live  # noqa: E741
                    if (u and l or literal and d and (u or l)) and i - s + 1 >= least
                ]
                if ends and max(ends)[0] >= 0:
                    gain, s = max(ends)
                    found.append((gain, s, i + 1))
    out: list[tuple[int, int, float]] = []
    for gain, s, e in sorted(found, key=lambda x: -x[0]):
        if all(e <= a or b <= s for a, b, _ in out):
            out.append((s, e, gain / (e - s) + threshold))
    return out


def base_spans(text: str) -> list[tuple[str, int, int, float | None]]:
    """Spans of the base patterns by start, then kind."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e, None) for s, k, e in sorted(found)]


def find_secrets(text: str, threshold: float, models: tuple[Automaton, ...]) -> list[tuple[str, int, int, float | None]]:
    spans = base_spans(text)
    added = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span(1)
        while e > s and text[e - 1] in ".=-/":
            e -= 1
        token = text[s:e]
        if e - s < SHORTEST or any(s < b and a < e for _, a, b, _ in spans):
            continue
        if (score := likelihood_ratio(token, models)) >= threshold:
            added.append(("inferred", s, e, score))
    # Runs that are none as a whole may hold credentials glued to names or paths.
    taken = sorted((s, e) for _, s, e, _ in spans + added)
    for m in RUN.finditer(text):
        if not any(c in m[0] for c in CUTS):
            continue
        at = m.start()
        for a, b in [*((a, b) for a, b in taken if a < m.end() and b > m.start()), (m.end(), m.end())]:
            if a - at >= SHORTEST:
                added += [("inferred", at + s, at + e, score) for s, e, score in inner_secrets(text[at:a], threshold, models)]
            at = max(at, b)
    order = {k: i for i, k in enumerate((*KINDS, "inferred"))}
    return sorted(spans + added, key=lambda x: (x[1], order[x[0]]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Secrets of every row: ``id_col`` and ``spans`` (kind, start, end, score).

    Offsets are code points, end exclusive; the score is null for base patterns.
    Null and empty texts have no spans; a null id is kept; repeated rows each give
    a row; an empty table gives none; other columns, whatever their names, are not
    read. Texts are scanned whole in the task that reads them: no shuffle.
    """

    models = df.sparkSession.sparkContext.broadcast(automata())

    def setup():  # noqa: ANN202
        return lambda texts: {"spans": spans_array([find_secrets(t, threshold, models.value) for t in texts])}

    return map_rows(df, [id_col], text_col, setup, SPANS_SQL)


def masked(text: str, spans: list[tuple[str, int, int, float | None]], mark: str) -> str:
    """Replace the union of the spans, overlapping ones once."""
    out, at = [], 0
    for _, s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(
    df: DataFrame, text_col: str = "text", threshold: float = 0.5, mark: str = "<secret>"
) -> DataFrame:
    """All rows and columns, with every secret of ``text_col`` replaced; a null text becomes empty."""
    models = df.sparkSession.sparkContext.broadcast(automata())

    def setup():  # noqa: ANN202
        def work(texts: list[str]) -> dict[str, pa.Array]:
            return {text_col: pa.array([masked(t, find_secrets(t, threshold, models.value), mark) for t in texts])}

        return work

    return map_rows(df, [c for c in df.columns if c != text_col], text_col, setup, f"`{text_col}` string").select(
        *[F.col(f"`{c}`") for c in df.columns]
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS))
    return found.select(
        id_col,
        *[count_kind(spans, k).alias(f"n_{k}") for k in KINDS],
        sha(joined_spans(base)).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
        count_kind(spans, "inferred").alias("n_inferred"),
    )
