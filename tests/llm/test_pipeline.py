"""The pipeline's stages and the registered queries."""

import weakref

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import same
from tickspark.llm import langid, packing, queries
from tickspark.sources import store


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
    lost = corpus_pipeline.simhash_dedup(spark, docs, sf)
    assert lost.count() < n and lost.select("doc_id").distinct().count() == lost.count()


def test_run(spark):
    before = store.tables()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(store.tables()) == len(before) + 1  # what the stages wrote on their way is gone
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_stages_of_edges(spark, edges):
    clashing = {"lang_pred": F.lit("mine"), "lang_score": F.lit(2.0), "rate": F.lit(0.0), "_p": F.lit(0.5), "h1": F.lit(1), "__findings": F.lit("mine")}
    docs, sf = edges.withColumns(clashing), "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert rows and stage(spark, docs.where("false"), sf).count() == 0, name
        if name != "best_fit_packing":
            assert out.columns == docs.columns and {(r.lang_pred, r.lang_score, r.rate, r.h1, r["__findings"]) for r in rows} == {("mine", 2.0, 0.0, 1, "mine")}, name


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert same(queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE[name]).df()).startswith("ok")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 or name == "op10_secret_scan"  # none is planted there


def test_foreign_and_junk_texts_go(spark):
    """Shuffled letters and an unlearned language go; clean texts and those that switch between all languages stay."""
    import random

    sf, rng = "/root/testdata/sf0.01", random.Random(3)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    own = {r.lang: r.text.split()[:40] for r in docs.where("lang IS NOT NULL AND length(text) BETWEEN 900 AND 3000").orderBy("doc_id").collect()}
    clean = [" ".join(w) for w in own.values()] + [" ".join(x for w in own.values() for x in w)]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(400)) for _ in range(5)]
    foreign = ["wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice rasy koloru płci języka wyznania", "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun väriin sukupuoleen kieleen uskontoon perustuvaa erotusta"]
    more = spark.createDataFrame([(-k - 1, t, None) for k, t in enumerate(clean + junk + foreign)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), sf).select("doc_id").collect()}
    assert {k for k in kept if k < 0} == {-k - 1 for k in range(len(clean))}
    assert len([k for k in kept if k >= 0]) > 0.99 * docs.count()


def test_workers_keep_one_operator():
    """What packing keeps from task to task goes when the worker turns to another stage; texts are read some rows at a time."""
    known = weakref.ref(packing.word_ids(queries.tokenizer_path()))
    assert known() is packing.word_ids(queries.tokenizer_path())
    texts = ["plain words of a text", None, "", "12 34", *(f"words {k}" for k in range(300))]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    model = langid.fit([("en", " ".join(t or "" for t in texts).split())])
    out = list(langid._kept(model, langid.Lexicon({}, 0.0))(iter([batch])))
    assert known() is None
    assert max(b.num_rows for b in out) <= 64
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches([batch.filter(pa.array([k not in (1, 2, 3) for k in range(len(texts))]))]).combine_chunks())
