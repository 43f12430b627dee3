"""Language identification by Bayesian evidence fusion.

Four kinds of evidence add up as log-probabilities of each language: the text
under byte-trigram models, the declared markup language, the address suffix, and a
prior of the host. Host priors come from one grouped aggregation of the text's own
verdicts and are smoothed hierarchically: a host's counts are drawn towards those
of its group, the group's towards those of the whole table. An extra class ``und``
stands for any other language: its text model is uniform over bytes.

Where the texts themselves are not asked for, each is scored once: the likelihoods
are written, and both the priors and the verdicts are computed from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm._common import Scratch, bounded, worker_state
from assayer.operators.graph import stored

UND = "und"
TABLE = 1 << 16  # hashed trigrams of a model
TRAIN_ROWS = 400  # labelled rows a language that the models may be fitted on, at most
MOST_LANGUAGES = 200  # models; one takes 256 KB
MARKUP_TRUST = 0.9  # chance that a declared language is the true one
SUFFIX_TRUST = 0.7
HOST_WEIGHT = 20.0  # rows that a host needs to count as much as its group
GROUP_WEIGHT = 200.0


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed trigrams at each place but the last two; A-Z in lower case, digits and signs as one."""
    x = FOLD[data].astype(np.uint32)
    return ((x[:-2] * 40503 + x[1:-1] * 2654435 + x[2:] * 97) >> 3) & (TABLE - 1)


FOLD = np.array(
    [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8
)


def counts_of(texts: list[str]) -> np.ndarray:
    out = np.zeros(TABLE, np.int64)
    for text in texts:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, len(raw) - 2, 1 << 18):
            out += np.bincount(trigrams(raw[at : at + (1 << 18) + 2]), minlength=TABLE)
    return out


class Models:
    """Trigram log-probabilities: one row a hashed trigram, one column a language and one for ``und``."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        logs = [np.log((counts[x] + 0.1) / (counts[x].sum() + 0.1 * TABLE)) for x in self.languages]
        logs.append(np.full(TABLE, -np.log(TABLE / 4)))
        blank = int(trigrams(np.frombuffer(b"   ", np.uint8))[0])
        self.logs = np.array(logs).T.astype(np.float32)
        self.logs[blank] = 0  # runs of spaces, digits and signs say nothing

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-likelihoods of whole texts less the best one's, long texts scored in parts."""
        out = np.zeros((len(texts), len(self.languages) + 1))
        for i, text in enumerate(texts):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            for at in range(0, len(raw) - 2, 1 << 18):
                out[i] += self.logs[trigrams(raw[at : at + (1 << 18) + 2])].sum(0, dtype=np.float64)
        return out - out.max(1, keepdims=True)


def fit(df: DataFrame, label_col: str, text_col: str, rows: int = TRAIN_ROWS) -> Models:
    """Models from at most ``rows`` different labelled texts a language, those of the lowest hash, whole.

    Every label makes a model, however few its rows, but null and ``und``; of a column with over
    ``MOST_LANGUAGES`` labels the most frequent ones do. Two scans serve all languages: one
    counts labels, one takes the sample, whose trigrams are counted where it is. Without labels there is no model.
    """
    named = F.col(label_col).isNotNull() & (F.col(label_col) != UND) & F.col(text_col).isNotNull()
    labelled = df.where(named).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    counts = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MOST_LANGUAGES).collect()
    if not counts:
        return Models({})
    # About four times the rows that are wanted, of each label, so that copies leave enough.
    shares = {r["label"]: int(min(1.0, 4.0 * rows / r["count"]) * (1 << 20)) for r in counts}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("label")]
    labelled = labelled.where(F.col("label").isin(list(shares)))
    hashed = labelled.select("label", "text", F.xxhash64("text").alias("h")).where(F.pmod("h", F.lit(1 << 20)) <= share)
    different = hashed.groupBy("label", "h").agg(F.first("text").alias("text"))
    order = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    sample = different.withColumn("n", order).where(F.col("n") <= rows).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            labels = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = batch.column(1).to_pylist()
            for label in sorted(set(labels.tolist())):
                made = counts_of([t for t, x in zip(texts, labels, strict=True) if x == label]).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([made], pa.binary())], names=["label", "counts"])

    total = {r["label"]: np.zeros(TABLE, np.int64) for r in counts}
    for r in sample.mapInArrow(count, "label string, counts binary").collect():  # some rows a language
        total[r["label"]] += np.frombuffer(r["counts"], "<i8")
    return Models(total)


def text_likelihoods(df: DataFrame, models: Models, text_col: str, carry: bool = True, out: str = "text_log") -> DataFrame:
    """Add the log-likelihoods of the text, languages first and ``und`` last; null for texts without letters.

    ``carry`` says whether the text stays.
    """
    held = df.sparkSession.sparkContext.broadcast(models)
    at = df.columns.index(text_col)
    stay = [i for i, c in enumerate(df.columns) if carry or i != at]
    kinds = ", ".join(f"`{df.columns[i]}` {df.schema[i].dataType.simpleString()}" for i in stay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(__name__)
        m = held.value
        for batch in bounded(batches, at):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            scores = m.score(texts).tolist()
            blank = [not any(map(str.isalpha, t)) for t in texts]
            made = pa.array([None if b else s for s, b in zip(scores, blank, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], made], names=[*[batch.schema.names[i] for i in stay], out])

    return df.mapInArrow(run, f"{kinds}, {out} array<double>" if stay else f"{out} array<double>")


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    grown = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(grown, lambda x: x / F.aggregate(grown, F.lit(0.0), lambda a, b: a + b))


def declared(code: Column, languages: list[str], trust: float) -> Column:
    """Log-evidence of a declared language; none for a null or unknown code."""
    n = len(languages)
    code = F.lower(F.substring_index(F.substring_index(F.trim(code), "-", 1), "_", 1))
    rows = [F.when(code == x, F.lit(trust)).otherwise(F.lit((1 - trust) / n)) for x in [*languages, UND]]
    known = code.isin(languages)
    return F.transform(F.array(*rows), lambda p: F.when(known, F.log(p)).otherwise(F.lit(0.0)))


def host_priors(scored: DataFrame, n: int) -> DataFrame:
    """Log-priors by ``group`` and ``host``, from the mean text posteriors of their rows.

    One aggregation by host, one of its result by group, one of all: a hot host is
    summed where it is read.
    """
    post = softmax(F.col("text_log"))
    sums = [F.sum(post[i]).alias(f"p{i}") for i in range(n)]
    # Stored, as the totals and the join both read it.
    hosts = stored(scored.where("text_log IS NOT NULL").groupBy("group", "host").agg(*sums))
    again = [F.sum(f"p{i}").alias(f"g{i}") for i in range(n)]
    groups = hosts.groupBy("group").agg(*again)
    whole = groups.agg(*[F.sum(f"g{i}").alias(f"w{i}") for i in range(n)]).first()
    total = [(whole[i] or 0.0) + 1.0 for i in range(n)]
    share = [x / sum(total) for x in total]
    size = sum((F.col(f"g{i}") for i in range(1, n)), F.col("g0"))
    of_group = [(F.col(f"g{i}") + GROUP_WEIGHT * share[i]) / (size + GROUP_WEIGHT) for i in range(n)]
    groups = groups.select(F.col("group").alias("of"), *[c.alias(f"q{i}") for i, c in enumerate(of_group)])
    mass = sum((F.col(f"p{i}") for i in range(1, n)), F.col("p0"))
    of_host = [(F.col(f"p{i}") + HOST_WEIGHT * F.col(f"q{i}")) / (mass + HOST_WEIGHT) for i in range(n)]
    return hosts.join(groups, F.col("group").eqNullSafe(F.col("of"))).select(
        "group", "host", F.array(*[F.log(c) for c in of_host]).alias("host_log")
    )


def identify(
    df: DataFrame,
    models: Models,
    text_col: str = "text",
    markup: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    group: Column | None = None,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Add ``language`` and ``confidence`` to every row, and keep its columns (or those in ``keep``).

    ``markup`` is the declared language, ``suffix`` a language code read from the
    address, ``host`` and its ``group`` the levels of the prior; any may be absent
    or null. A text that is null, empty or without letters gets ``und`` with
    confidence 0, whatever it declares. Ties go to the first language by name.
    Repeated rows are judged alike; an empty table gives no rows. Without models every
    row is ``und`` with confidence 0. Columns of ``df`` named ``language`` or ``confidence`` are replaced.
    """
    if not models.languages:
        kept = [c for c in (df.columns if keep is None else keep) if c not in ("language", "confidence")]
        return df.select(*[F.col(f"`{c}`") for c in kept], F.lit(UND).alias("language"), F.lit(0.0).alias("confidence"))
    names = [*models.languages, UND]
    n = len(names)
    own = [c for c in (df.columns if keep is None else keep) if c not in ("language", "confidence")]
    null = F.lit(None).cast("string")
    evidence = {"markup": markup, "suffix": suffix, "host": host, "group": group}
    # Own columns go by number, so that none clashes; a text that is kept travels once.
    columns = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(own)}
    carry = text_col in own and df.schema[text_col].dataType.simpleString() == "string"
    text = f"c{own.index(text_col)}" if carry else "text"
    if not carry:
        columns["text"] = F.col(f"`{text_col}`").cast("string")
    row = df.select(*[c.alias(a) for a, c in columns.items()], *[(null if c is None else c).cast("string").alias(a) for a, c in evidence.items()])
    whole = carry or text_col in own
    scored = text_likelihoods(row, models, text, carry)
    logs = [
        F.col("text_log"),
        declared(F.col("markup"), models.languages, MARKUP_TRUST),
        declared(F.col("suffix"), models.languages, SUFFIX_TRUST),
    ]
    tables = Scratch(df.sparkSession, "language") if host is not None and not whole else None
    if tables:
        scored = tables.put(scored)
    if host is not None:
        light = scored if tables else text_likelihoods(row.select(F.col(text).alias("text"), "host", "group"), models, "text", False)
        priors = host_priors(light, n).select(F.col("group").alias("__g"), F.col("host").alias("__h"), "host_log")
        same = F.col("group").eqNullSafe(F.col("__g")) & F.col("host").eqNullSafe(F.col("__h"))
        scored = scored.join(small_or_not(priors), same, "left")
        logs.append(F.coalesce("host_log", F.array(*[F.lit(0.0)] * n)))
    total = logs[0]
    for more in logs[1:]:
        total = F.zip_with(total, more, lambda a, b: a + b)
    best = F.col("__post")
    named = F.element_at(F.array(*map(F.lit, names)), F.array_position(best, F.array_max(best)).cast("int"))
    judged = scored.withColumn("__post", softmax(total)).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(own)],
        F.when(best.isNull(), UND).otherwise(named).alias("language"),
        F.coalesce(F.array_max(best), F.lit(0.0)).alias("confidence"),
    )
    if tables:
        judged = stored(judged)
        tables.drop()
    return judged


def small_or_not(priors: DataFrame) -> DataFrame:
    """Broadcast a table of priors if it is counted small; a shuffled join serves the rest."""
    return F.broadcast(priors) if priors.limit(20_001).count() <= 20_000 else priors


def address_code(address: Column, languages: list[str]) -> Column:
    """A language code that is a path segment or the last label of the host; null if there is none."""
    codes = "|".join(languages) or "$"
    return F.coalesce(
        F.nullif(F.regexp_extract(address, rf"^(?:[^/?#]*://)?[^/?#]*/({codes})(?:[/?#]|$)", 1), F.lit("")),
        F.nullif(F.regexp_extract(address, rf"^(?:[^/?#]*://)?[^/?#]*\.({codes})(?:[:/?#]|$)", 1), F.lit("")),
    )


def host_of(address: Column) -> Column:
    return F.lower(F.regexp_extract(address, r"^(?:[^/?#]*://)?([^/?#]*)", 1))


def registered(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def identify_documents(docs: DataFrame, models: Models, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Documents: ``lang`` is the declared language; ``source`` is the address, whose suffix, host and registered name count."""
    source = F.col("source")
    host = host_of(source)
    return identify(docs, models, "text", F.col("lang"), address_code(source, models.languages), host, registered(host), keep)


def identify_pages(pages: DataFrame, models: Models, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Pages: the markup's ``lang``, a language code in the address, the host and its registered name."""
    html, url = F.col("html"), F.col("url")
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    host = host_of(url)
    return identify(
        pages.withColumn("__plain", text),
        models,
        "__plain",
        F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1),
        address_code(url, models.languages),
        host,
        registered(host),
        keep if keep is not None else tuple(pages.columns),
    )


def accepted() -> Column:
    """Rows that the pipeline keeps: those in one of the languages."""
    return F.col("language") != UND
