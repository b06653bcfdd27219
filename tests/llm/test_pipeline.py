"""Every stage of the pipeline against brute force or its law; the queries with SQL against DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from salesspark.llm import bpe, catalog, near_dup, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_queries_match_sql(spark, name):
    got = E.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(catalog.ORACLE[name]).df()[list(got.columns)]

    def plain(df):
        return sorted(df.astype(object).where(df.notna(), None).values.tolist(), key=str)

    assert len(want) and plain(got) == plain(want)


def test_every_operator_has_a_query():
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dup", "mixing", "bpe"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(P.STAGES)
    good = stage["quality"](spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r[0] for r in good.select("doc_id").collect()}
    clean = [r["doc_id"] for r in labels.filter("quality = 1").collect()]
    assert good.columns == docs.columns and sum(i in kept for i in clean) >= 0.97 * len(clean)

    lines = stage["line_dedup"](spark, docs, SF)
    assert lines.columns == docs.columns and lines.count() == docs.count()

    near = stage["near_dup"](spark, docs, SF).cache()
    found = near_dup.near_duplicates(docs.select("doc_id", "text")).collect()
    assert {r["doc_id"] for r in near.collect()} == {r["doc_id"] for r in found if r["doc_id"] == r["component_id"]}

    mixed = stage["mixing"](spark, docs, SF)
    words = {r[0]: r[1] for r in docs.select("doc_id", F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))).collect()}
    taken = sum(words[r["doc_id"]] for r in mixed.collect())
    assert mixed.columns == docs.columns and taken == pytest.approx(1.5 * sum(words.values()), rel=0.05)

    with open(P.public_tokenizers.path(P.VOCABULARY), "rb") as f:
        codec = bpe.Codec(f.read())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = stage["bpe"](spark, docs, SF).collect()
    assert len(rows) == docs.count() and all(codec.decode(r["ids"]) == texts[r["doc_id"]] for r in rows)


def test_pipeline_runs_and_hard_rows_pass(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and "ids" in out.columns
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "a b c d e f " * 9000, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        for given in (docs, docs.limit(0)):
            got = stage(spark, given, SF)
            assert (got.columns == docs.columns) == (name != "bpe") and got.count() <= 2 * given.count()


def test_score_sees_the_text_only(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (999, "some text", "fr")], "doc_id long, text string, lang string")
    weights = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert len({r["score"] for r in quality.scored(docs, weights).collect()}) == 1


def test_near_dup_stage_keeps_texts_that_share_an_id(spark):
    """Fifty unrelated texts under one doc_id all stay; of its copies of another text, and of equal rows, one stays."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(53)]
    rows = [(7, t) for t in texts[:50]] + [(3, texts[50]), (7, texts[50] + " more"), (7, texts[51]), (7, texts[51]), (7, texts[51].upper()),
                                           (None, texts[50]), (None, None), (8, ""), (8, ""), (9, texts[52])]
    docs = spark.createDataFrame([(i, t, "row", 1, 2, 3, 4, 5) for i, t in rows],
                                 "doc_id long, text string, row string, k_doc int, nth int, score int, t1 int, component int")
    got = dict(P.STAGES)["near_dup"](spark, docs, SF)
    assert got.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(7, t) for t in texts[:50]] + [(3, texts[50])] + [
        x for x in left if x[1] and x[1].lower() == texts[51].lower()] + [(None, texts[50]), (None, None), (8, ""), (8, ""), (9, texts[52])]))
    assert sum(bool(t) and t.lower() == texts[51].lower() for _, t in left) == 1


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumns(
        {c: F.lit(c) for c in ("row", "k_doc", "nth", "score", "doc", "t", "size", "copies", "alone", "keep", "n_dropped", "source_size")})
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and (name in ("quality", "near_dup", "mixing") or got.count() == 40)
        assert got.filter("row <> 'row' OR k_doc <> 'k_doc' OR score <> 'score'").count() == 0
