import corpus_pipeline as P
from costlens.llm.common import table
from costlens.llm.quality import quality_report, train
from costlens.llm.simhash import simhash_duplicates
from tests.conftest import SMOKE


def test_stages_follow_their_operators(spark):
    docs = table(spark, SMOKE, "documents")
    kept = {r.doc_id for r in quality_report(docs, train(docs, table(spark, SMOKE, "labels"))).where("kept").collect()}
    one = P.quality(spark, docs, SMOKE).cache()
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    groups = simhash_duplicates(one).collect()
    two = P.near_duplicates(spark, one, SMOKE).cache()
    assert sorted(r.doc_id for r in two.collect()) == sorted({r.component_id for r in groups})
    three = P.personal_data(spark, two, SMOKE).cache()
    assert three.columns == docs.columns and three.count() == two.count()
    four = P.packing(spark, three, SMOKE).toPandas()
    assert set(four.doc_id) == {r.doc_id for r in three.collect()}
    assert (four.groupby("sequence_id").length.sum() <= 4096).all()
    assert [k for k, _ in P.STAGES] == ["quality", "near_duplicates", "personal_data", "packing"]


def test_stages_take_odd_rows(spark, odd_rows, no_rows):
    for docs in (odd_rows, no_rows):
        now = docs
        for _, stage in P.STAGES[:-1]:
            now = stage(spark, now, SMOKE)
            assert now.columns == docs.columns
        assert P.STAGES[-1][1](spark, now, SMOKE).count() == now.count()


def test_run_gives_the_last_stage(spark):
    out = P.run(spark, SMOKE)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
