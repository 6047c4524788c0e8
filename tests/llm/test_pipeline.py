import corpus_pipeline
from galeframe.llm import registry

from .test_pairs import stages

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_pack_what_is_left(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL).cache()
        assert out.columns == docs.columns, name
        assert out.count() <= before
        docs, before = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, SMALL).count() == packed.count()


def test_stages_on_nulls_repeats_and_clashing_names(make, prose):
    near = prose(3, 200).split()
    rows = [(None, prose(1, 20)), (1, None), (2, ""), (3, "a b"), (3, "a b"), (3, "c d"), (None, None), (4, prose(2, 30_000))]
    rows += [(10 + k, " ".join([*near[:k], f"new{k}", *near[k + 1 :]])) for k in range(3)] + [(20, " ".join(near))] * 2
    docs = make(rows).withColumnRenamed("__id", "gone_key")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(docs.sparkSession, docs, SMALL)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert stage(docs.sparkSession, docs.limit(0), SMALL).count() == 0, name
        docs = make([(r.doc_id, r.text) for r in out.collect()]).withColumnRenamed("__id", "gone_key")
    kept = sorted((r.doc_id or 0, len(r.text or "")) for r in docs.collect())
    # of equal texts the largest id, of near copies the smallest
    assert [i for i, _ in kept] == [0, 2, 3, 3, 4, 10]
    packed = corpus_pipeline.STAGES[-1][1](docs.sparkSession, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == 5


def test_near_copies_take_few_stages(spark, make, prose):
    """Shuffles of few rows cost a file for each partition of the session, so their number is what fills the disk."""
    words = prose("near", 100).split()
    docs = make([(k, " ".join([*words[:k], f"new{k}", *words[k + 1 :]])) for k in range(40)])
    assert stages(spark, lambda: corpus_pipeline.near_copies(spark, docs, SMALL).collect()) <= 80


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in registry.QUERIES} == {f"op{n}" for n in range(1, 14)}
