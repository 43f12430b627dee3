"""The pipeline's stages against plain versions of what each one does."""

import base64
import hashlib
import struct

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_operators import brute_hits

from assayer.llm import decontaminate, language_id, near_dedup, secrets

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.build(items, decontaminate.WINDOW)
    want = set()
    for i, text in texts.items():
        if any(map(str.isalpha, text)) and classes[i] == i and not decontaminate.scan(text, index)[1]:
            want.add(i)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == want
    models = secrets.automata()
    for i in want:
        assert (secrets.find_secrets(texts[i], 0.5, models) == []) or got[i]["n_tokens"] > 0


def test_stage_names_and_columns(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scan", "bpe"]
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[2:4]:
        assert stage(spark, none, SF).columns == corpus_pipeline.COLUMNS


def test_result_is_the_tokens_of_the_redacted_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = language_id.fit(docs, "lang", "text")
    judged = {r["doc_id"]: r["language"] for r in language_id.identify_documents(docs, models).where(language_id.accepted()).collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in judged}
    sets = {i: near_dedup.hashed(r["text"], near_dedup.SHINGLE, False) for i, r in rows.items()}
    parent = {i: i for i in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(rows)
    for i in order:
        for j in order:
            if j < i and len(sets[i][0]) and len(sets[j][0]) and near_dedup.similarity(sets[i], sets[j]) >= near_dedup.SIMILARITY:
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, *_, hit in brute_hits([(i, r["text"]) for i, r in rows.items()], items) if hit}
    kept = [i for i in order if find(i) == i and i not in leaks]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == kept
    n_marks = 0
    for i in kept:
        text, hidden = rows[i]["text"], set()
        for _, s, e, _ in secrets.find_secrets(text, 0.5, secrets.automata()):
            n_marks += 1
            hidden |= set(range(s, e))
        starts = {s for _, s, _, _ in secrets.find_secrets(text, 0.5, secrets.automata())}
        plain = "".join(
            "<secret>" if at in starts and at - 1 not in hidden else "" if at in hidden else c for at, c in enumerate(text)
        )
        want = struct.pack(f"<{len(ids := tokens.encode_ordinary(plain))}I", *ids)
        row = got[i]
        assert (bytes(row["ids"]), row["n_tokens"], row["lang"], row["source"]) == (want, len(ids), judged[i], rows[i]["source"])
        assert row["ids_sha256"] == hashlib.sha256(want).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
    assert n_marks


def test_rows_with_null_and_repeated_ids(spark):
    words = "river stone winter night people bridge water field house morning garden window letter music paper forest".split()
    text = lambda k: " ".join(words[(i * k + i // 3) % len(words)] for i in range(60))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").orderBy(F.length("text").desc()).first()
    rows = [(1, text(1)), (1, text(5)), (None, text(7)), (None, text(7)), (2, text(1) + " end"), (None, "so " + items["text"]), (3, items["text"])]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"] is None, r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs.limit(5), SF).collect())
    assert kept == sorted([(False, text(1)), (False, text(5)), (True, text(7))])
    clean = [r["text"] for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()]
    assert sorted(clean) == sorted(t for _, t in rows[:5])
