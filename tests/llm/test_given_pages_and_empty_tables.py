"""Every given page keeps its article; language identification and the pipeline without rows or labels."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from assayer.llm import html_extract, language_id

LINES = frozenset("p h1 h2 h3 h4 li div article blockquote section ul ol table tr td aside nav footer header form".split())


class Article(HTMLParser):
    """Lines of the ``<article>`` elements by a plain parser of another hand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.lines, self.run = 0, [], []

    def end_line(self):
        line = re.sub(r"\s+", " ", "".join(self.run)).strip()
        self.run = []
        if line:
            self.lines.append(line)

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if self.depth and tag in LINES:
            self.end_line()
        if self.depth and tag == "br":
            self.run.append(" ")

    def handle_endtag(self, tag):
        if self.depth and tag in LINES:
            self.end_line()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth > 0:
            self.run.append(data)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_no_given_page_loses_or_gains_a_line(spark, sf):
    pages = [r["html"] or "" for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("html").collect()]
    differ = []
    for page, text in zip(pages, html_extract.extract_texts(pages, html_extract.fit(spark)), strict=True):
        plain = Article()
        plain.feed(page)
        plain.close()
        if "\n".join(plain.lines) != text:
            differ.append(page)
    assert differ == []


def test_odd_paragraphs_stay_with_their_siblings(spark):
    said = "The river froze in the night, and people walked across it. Nobody had seen this before."
    odd = ["snow " * 100, "word | other | third | fourth", "ice", "no end at all and " * 20]
    page = "<body><nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>{x}</p><p>{said}</p>" for x in odd) + "</article><footer>&copy; x</footer></body>"
    got = html_extract.extract_texts([page], html_extract.fit(spark))[0].split("\n")
    assert got == [x for o in odd for x in (re.sub(r"\s+", " ", o).strip(), said)]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


ROWS = [(1, "the house by the river", None, "src0", 22), (2, None, None, None, None), (3, "", None, "src1", 0), (3, "123", None, "src1", 3)]


def test_language_without_rows_or_labels(spark):
    for docs in (documents(spark, []), documents(spark, ROWS)):
        models = language_id.fit(docs, "lang", "text")
        assert models.languages == []
        judged = language_id.identify_documents(docs, models, keep=("doc_id",)).collect()
        assert sorted(r["doc_id"] for r in judged) == sorted(r["doc_id"] for r in docs.collect())
        assert all((r["language"], r["confidence"]) == (language_id.UND, 0.0) for r in judged)


def test_more_labels_than_models(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    texts = {"en": "the house by the river", "fr": "la maison de la rivière", "zz": "qqq www"}
    docs = documents(spark, [(i, f"{t} {i}", x, "s", 1) for x, t in texts.items() for i in range(1 if x == "zz" else 5)])
    models = language_id.fit(docs, "lang", "text")
    assert models.languages == ["en", "fr"]
    assert language_id.identify_documents(docs, models).count() == docs.count()


@pytest.mark.parametrize("rows", [[], ROWS])
def test_pipeline_without_rows_or_labels(spark, tmp_path, rows):
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} <= set(got.columns)


def test_stages_on_no_rows_keep_the_columns(spark):
    none = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, none, "/root/testdata/sf0.001")
        assert (left.columns, left.count()) == (corpus_pipeline.COLUMNS, 0)
