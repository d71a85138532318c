import corpus_pipeline as P
from terrane.llm.queries import QUERIES


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), docs.schema)
        assert now.columns == docs.columns, name
        left = {r.doc_id for r in now.collect()}
        assert left <= seen and len(left) > 0.5 * len(seen)
        seen = left
    assert {r.doc_id for r in P.run(spark, folder).collect()} == seen


def test_empty_table(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 13))


def test_stages_take_nasty_rows(spark, nasty):
    """Null ids and texts, repeated rows and clashing columns go through every stage."""
    folder = "/root/testdata/sf0.001"
    now = nasty
    for name, stage in P.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), nasty.schema)
        assert now.columns == nasty.columns, name
    mixed = P.STAGES[-1][1](spark, now, folder)
    assert mixed.count() == now.count() > 0
