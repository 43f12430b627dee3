"""Personal data with offset-preserving deobfuscation.

The base patterns run on the text as it is. Then transducers rewrite disguised
text: look-alike characters to ASCII, spelled digits to digits, bracketed or
spelled "at" and "dot" to their signs. Each output character remembers the source
span it came from, so what the patterns find in the normalised text is mapped
back to source characters; spans that no base span touches are added.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._common import SPANS_SQL, count_kind, joined_spans, map_rows, sha, spans_array

# Fixed values of the base patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A leftmost match starts where a run of digits does, and each part is a whole run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from its @ signs outwards.

    A match starts where the run of local characters before an @ does, or where
    the match before ended; that is what a leftmost search finds.
    """
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            floor = domain.end()
        at = text.find("@", max(floor, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int, float | None]]:
    """Spans by kind as listed, then start."""
    out = [("email", s, e, None) for s, e in emails(text)]
    out += [
        ("ip", *m.span(), None)
        for m in IP.finditer(text)
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))
    ]
    cards = (m for m in CARD.finditer(text) if m.end() - m.start() >= 13)
    out += [("card", *m.span(), None) for m in cards if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span(), None) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


# Look-alike characters that no compatibility form maps to ASCII, by script.
HOMOGLYPHS = str.maketrans(
    # Cyrillic
    "аеорсухіјѕԁһԛԝѵӏ" "АВЕКМНОРСТУХІЈЅԌԚԜѴӀҮ"
    # Greek
    "αονρικυγ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
    # Armenian
    "ոսօհցզ" "ՕՏՍ"
    # Cherokee
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ"
    # Phonetic and small capital letters
    "ɑɡɩʏᴄᴏᴠᴡᴢꜱ"
    # Signs
    "＠。．‐‑‒–−",
    "aeopcyxijsdhqwvl" "ABEKMHOPCTYXIJSGQWVIY"
    "aovpikuy" "ABEZHIKMNOPTYX"
    "nuohgq" "OSU"
    "DRTAJEWMHGZVSLCPKB"
    "agiycovwzs"
    "@..-----",
)
# Digits in words.
SPELLED = dict(zip("zero one two three four five six seven eight nine oh".split(), "01234567890", strict=True))
NAMES = "|".join(SPELLED)
#: Runs of at least four spelled digits, or spelled among written ones.
DIGIT_RUN = re.compile(rf"\b(?i:{NAMES})(?:[\x20,.-]{{1,2}}(?:(?i:{NAMES})\b|[0-9]+)){{3,}}")
DIGIT_WORD = re.compile(rf"(?i:{NAMES})\b|[0-9]+")
AT = re.compile(r"\x20?(?:\[\x20?(?i:at|@)\x20?\]|\(\x20?(?i:at|@)\x20?\)|\{\x20?(?i:at|@)\x20?\}|<\x20?(?i:at)\x20?>)\x20?")
DOT = re.compile(r"\x20?(?:\[\x20?(?i:dot|\.)\x20?\]|\(\x20?(?i:dot|\.)\x20?\)|\{\x20?(?i:dot|\.)\x20?\}|<\x20?(?i:dot)\x20?>)\x20?")
#: "name at host dot tld", spelled out: both words are needed. Found from "at" outwards.
SPOKEN_AT = re.compile(r"\x20(?i:at)(?=\x20)")
SPOKEN_HOST = re.compile(r"\x20[A-Za-z0-9-]+(?:\x20(?i:dot)\x20[A-Za-z0-9-]+)+")
SPOKEN_DOT = re.compile(r"\x20(?i:dot)\x20")
ODD = re.compile(r"[\xad]|[^\x00-ɏ]")
HIDDEN = frozenset("​‌‍⁠﻿­")


class Offsets:
    """A text under rewriting; each character knows its source span."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start: list[int] | None = None  # until something is rewritten, characters are their own source
        self.end: list[int] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the current text, in order and without overlap."""
        if not edits:
            return
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start = start + self.start[at:]
        self.end = end + self.end[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


@lru_cache(maxsize=10_000)
def plain(char: str) -> str:
    """One character without disguise."""
    if char in HIDDEN:
        return ""
    mapped = char.translate(HOMOGLYPHS)
    if mapped != char:
        return mapped
    folded = unicodedata.normalize("NFKC", char)
    if folded.isascii():
        return folded
    digit = unicodedata.digit(char, None)
    return str(digit) if digit is not None else char


def look_alikes(text: str) -> list[tuple[int, int, str]]:
    """Edits of disguised characters: those that stand for a digit or sign anywhere, letters in mixed words.

    A word is mixed if it also has ASCII letters, digits or an @; each is looked at once.
    """
    out, end, mixed = [], 0, False
    for m in ODD.finditer(text):
        i = m.start()
        new = plain(text[i])
        if new == text[i]:
            continue
        if new.isalpha():
            if i >= end:
                begin, end = i, i + 1
                while begin > 0 and not text[begin - 1].isspace():
                    begin -= 1
                while end < len(text) and not text[end].isspace():
                    end += 1
                word = text[begin:end]
                mixed = any(c.isascii() and c.isalnum() for c in word) or any(plain(c) == "@" for c in set(word))
            if not mixed:
                continue
        out.append((i, i + 1, new))
    return out


def spoken(text: str) -> list[tuple[int, int, str]]:
    """Edits of spelled "at" and "dot" in addresses."""
    out, floor = [], 0
    for m in SPOKEN_AT.finditer(text):
        at = m.start()
        if at <= floor or text[at - 1] not in LOCAL_CHARS:
            continue
        host = SPOKEN_HOST.match(text, m.end())
        if host:
            floor = host.end()
            out.append((at, m.end() + 1, "@"))
            out += [(d.start(), d.end(), ".") for d in SPOKEN_DOT.finditer(text, m.end() + 1, floor)]
    return out


def normalise(text: str) -> Offsets | None:
    """The text without disguises; None when it has none."""
    out = Offsets(text)
    if not text.isascii():
        out.rewrite(look_alikes(text))
    edits = []
    if any(c in out.text for c in "[({<"):
        edits += [(m.start(), m.end(), "@") for m in AT.finditer(out.text)]
        edits += [(m.start(), m.end(), ".") for m in DOT.finditer(out.text)]
    low = out.text.lower()
    if " at " in low and " dot " in low:
        edits += spoken(out.text)
    for run in DIGIT_RUN.finditer(out.text):
        words = list(DIGIT_WORD.finditer(out.text, run.start(), run.end()))
        for w, after in zip(words, [*words[1:], None], strict=True):
            edits.append((w.start(), w.end(), SPELLED.get(w[0].lower(), w[0])))
            if after and out.text[w.end() : after.start()] != ".":
                edits.append((w.end(), after.start(), ""))
    clean, at = [], 0
    for a, b, new in sorted(edits):
        if a >= at:
            clean.append((a, b, new))
            at = b
    out.rewrite(clean)
    return out if out.text != text else None


def find_pii(text: str) -> list[tuple[str, int, int, float | None]]:
    spans = base_spans(text)
    plainer = normalise(text)
    if plainer is None:
        return spans
    taken = np.zeros(len(text) + 1, bool)  # characters of spans that stand
    for _, s, e, _ in spans:
        taken[s:e] = True
    for kind, a, b, _ in base_spans(plainer.text):
        s, e = plainer.source(a, b)
        if plainer.text[a:b] != text[s:e] and not taken[s:e].any():
            spans.append((kind, s, e, 1.0))
            taken[s:e] = True
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


def redact(text: str, spans: list[tuple[str, int, int, float | None]]) -> str:
    """Replace each span by its kind; of overlapping ones the leftmost."""
    out, at = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every row: ``id_col`` and ``spans`` (kind, start, end, score).

    Offsets are code points of the source, end exclusive; the score is 1 for
    spans that only the normalised text shows and null for base spans. Null and
    empty texts have none; null ids and repeated rows are kept; other columns are
    not read. Whole texts are scanned where they are read: no shuffle.
    """

    def setup():  # noqa: ANN202
        return lambda texts: {"spans": spans_array([find_pii(t) for t in texts])}

    return map_rows(df, [id_col], text_col, setup, SPANS_SQL)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["score"].isNull())
    return found.select(
        id_col,
        *[count_kind(base, k).alias(f"n_{k}") for k in KINDS],
        sha(joined_spans(base)).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
        (F.size(spans) - F.size(base)).cast("long").alias("n_disguised"),
    )
