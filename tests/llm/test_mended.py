"""Faults of earlier rounds that must not come back: lost articles, one text that empties a sample, columns of any name."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridimpact.llm import html_extract, quality_classifier, secret_scan, toxicity
from gridimpact.llm.queries import ORACLES

LINE = "The committee met on Tuesday to discuss the plan, and after a long debate it agreed to wait."
MENU = "<nav><a href=/>Home</a> <a href=/x>News</a></nav>"
PAGES = {
    "short": ("<main><p>Short note.</p></main>", "Short note."),
    "plain": ("<p>plain", "plain"),
    "table": (
        f"<html><body>{MENU}<div class='post'><h1>Title here</h1><p>{LINE}</p><table><tr><th>Name</th><th>Size</th></tr><tr><td>Alpha</td><td>12</td></tr><tr><td>Beta</td><td>7</td></tr></table><p>{LINE} Again.</p></div><footer>Copyright 2020</footer></body></html>",
        f"Title here\n{LINE}\nName\nSize\nAlpha\n12\nBeta\n7\n{LINE} Again.",
    ),
    "list": (
        f"<body><div class='menu'><ul><li><a href=#>One</a><li><a href=#>Two</a></ul></div><article><h1>Things</h1><p>{LINE}</p><ul><li>apples</li><li>pears and plums</li><li>salt</li></ul><p>{LINE} More.</p></article><div class='sidebar'><h3>Related</h3><ul><li><a href=#>x</a></li></ul></div></body>",
        f"Things\n{LINE}\napples\npears and plums\nsalt\n{LINE} More.",
    ),
    "header": (f"<body><header><div>My Site</div></header><article><header><h1>Big Title</h1></header><p>{LINE}</p><p>Yes.</p><p>{LINE} End.</p></article><footer>Terms</footer></body>", f"Big Title\n{LINE}\nYes.\n{LINE} End."),
    "headless": (f"<p>{LINE}</p><p>No.</p><p>{LINE} Then.</p>", f"{LINE}\nNo.\n{LINE} Then."),
    "menu": (MENU, ""),
}


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels", "pages"))


def test_articles_are_kept_whole(spark, tables):
    pages = tables[2].select("page_id", "url", "html")
    own = spark.createDataFrame([(-1 - k, "u", source) for k, (source, _) in enumerate(PAGES.values())], pages.schema)
    out = {r.page_id: r.text for r in html_extract.main_text(pages.union(own)).where("page_id < 0").collect()}
    assert {name: out[-1 - k] for k, name in enumerate(PAGES)} == {name: text for name, (_, text) in PAGES.items()}


def test_one_long_text_does_not_empty_the_sample(tables):
    documents, labels, _ = tables
    sample = toxicity.labelled_sample(documents, labels, "toxic", 5, 0, 6000, 1_000_000)
    n, first = sample.count(), sample.orderBy(F.xxhash64("id"), "id").first().id
    longer = documents.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("x"), 1_500_000)).otherwise(F.col("text")))
    assert toxicity.labelled_sample(longer, labels, "toxic", 5, 0, 6000, 1_000_000).count() == n - 1
    assert toxicity.labelled_sample(documents, labels, "toxic", 5, 0, 6000, 40_000).agg(F.sum(F.octet_length("text"))).first()[0] <= 40_000


def test_quality_keeps_columns_of_any_name(tables):
    documents, labels, _ = tables
    names = ("_n", "_lines", "_text", "_words", "_chars", "_score", "_stat_bars", "_STAT_digits")
    plain = {r.doc_id: r.score for r in quality_classifier.quality_scores(documents, labels).collect()}
    more = documents.withColumns({c: F.lit(f"own {c}") for c in names})
    out = quality_classifier.quality_scores(more, labels, keep=more.columns)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *names, "held_out", "score", "predicted"]
    for r in out.collect():
        assert r.score == pytest.approx(plain[r.doc_id]) and all(r[c] == f"own {c}" for c in names)


def test_secret_sql_has_the_rule_that_runs(spark):
    duckdb = pytest.importorskip("duckdb")
    key, secret = "AKIA" + "Q7" * 8, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLE123"
    texts = [f"{key} aws_secret_access_key={secret} https://example.org", f"{key}\nexport X-KEY-{secret}_", f"{key} a={secret}b", f"a={secret}", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    out = {r.doc_id: tuple(r) for r in secret_scan.secret_digest(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: tuple(r) for r in c.execute(ORACLES["op3_secret_scan"]).fetchall()} == out
    assert "linked_secret" in out[0][-1] and "linked_secret" in out[1][-1]
