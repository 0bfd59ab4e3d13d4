import corpus_pipeline
from spanlake.llm import language_id, mixture_tree, near_dedup, packing_tiers, quality_llr, queries
from tests.llm.helpers import odd_docs


def test_each_stage_acts_on_what_its_predecessor_kept(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df, where="true": {r.doc_id for r in df.where(where).select("doc_id").collect()}
    (_, tell), (_, good), (_, copies), (_, mixed), (_, pack) = corpus_pipeline.STAGES
    a = tell(spark, docs, sf)
    assert a.columns == docs.columns
    assert ids(a) == ids(language_id.identify(docs, language_id.language_model(docs)), "not rejected")
    b = good(spark, a, sf)
    assert b.columns == docs.columns and ids(b) == ids(quality_llr.judge(a, spark.read.parquet(f"{sf}/labels.parquet")), "kept")
    c = copies(spark, b, sf)
    assert c.columns == docs.columns and ids(c) == ids(near_dedup.groups(b), "kept") and len(ids(c)) < len(ids(b))
    d = mixed(spark, c, sf)
    assert d.columns == docs.columns and ids(d) == ids(mixture_tree.mix(c, corpus_pipeline.MIX_SHARE, 1))
    e = pack(spark, d, sf).toPandas()
    assert set(e.doc_id) == ids(d)
    want = {r.doc_id: len(packing_tiers.token_ids(r.text)) for r in d.collect()}
    assert e.groupby("doc_id").length.sum().to_dict() == want
    ran = corpus_pipeline.run(spark, sf).toPandas()
    key = ["doc_id", "start"]
    assert ran.sort_values(key).reset_index(drop=True).equals(e.sort_values(key).reset_index(drop=True))


def test_stages_take_odd_rows(spark, sf):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_every_operator_has_a_query():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{n}" for n in range(1, 11)]
