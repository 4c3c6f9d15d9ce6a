"""The pipeline against its stages done one by one on the driver, and the registered oracles."""

import duckdb
import pytest
from test_llm_search import hits_plain
from test_llm_text import link_plain

import __spark_entry__ as entry
import corpus_pipeline
from terrasift.llm import pieces, quality, toxicity
from terrasift.llm.catalog import QUERIES
from terrasift.sources.views import BASE

DIR = "/root/testdata/sf0.001"


def test_stages_match_a_plain_version(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    bad = quality.score(docs, quality.fit(docs, labels)).filter("score < 0.3").select("doc_id")
    left = docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
    rude = toxicity.score(left, toxicity.fit(left, labels)).filter("score >= 0.5").select("doc_id")
    left = left.join(rude, "doc_id", "left_anti").select(*docs.columns)
    text = {r.doc_id: r.text for r in left.collect()}
    one = {i for i, _, _, kept in link_plain(sorted(text.items()), 5, 80) if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = {i for i in one if hits_plain(text[i], items)[1] == 0}
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert set(got) == clean and 0 < len(clean) < len(text)
    assert all(list(r.ids) == sp.encode(text[i]) and r.round_trip for i, r in got.items())


def test_stages_of_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "x y z " * 5000, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS score", "2 AS hits", "3 AS kept")
    names = docs.columns
    for df in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, DIR)
            if name != "pieces":
                assert df.columns == names, name
            df.write.parquet(str(tmp_path / f"{name}-{df.count()}"), mode="overwrite")
            df = spark.read.parquet(str(tmp_path / f"{name}-{df.count()}"))


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cur = con.execute(QUERIES[name][1])
    cols = [c[0] for c in cur.description]
    df = entry.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, cur.fetchall()))


def test_names():
    got = entry.queries()
    assert "pipeline" in got and all(any(n.startswith(f"op{i}_") for n in got) for i in range(1, 14))
