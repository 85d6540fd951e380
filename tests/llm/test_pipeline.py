"""The stages in turn, each on what its predecessor kept."""

import corpus_pipeline
from docflow.llm import neardup, quality
from docflow.llm.common import stash


def test_stages(spark, docs):
    now, names = docs, docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stash(stage(spark, now, "unused"), "stage")
        if name != "packing":
            assert now.columns == names
        kept.append((name, before, now))
    steps = {name: (before, after) for name, before, after in kept}
    before, after = steps["quality rules"]
    judged = quality.judge(before, ["doc_id", "source"])
    assert after.count() == judged.where("kept").count() < before.count()
    before, after = steps["line dedup"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect())
    before, after = steps["near duplicates"]
    groups = {r.component_id for r in neardup.clusters(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(groups) and after.count() < before.count()
    before, after = steps["personal data"]
    assert after.count() == before.count()
    before, after = steps["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_empty_table(spark, empty):
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = stash(stage(spark, now, "unused"), "stage")
    assert now.count() == 0


def test_of_rows_of_one_id_the_same_stays_in_every_run(spark):
    rows = [(1, " ".join(f"{w}{k}{i}" for i in range(60)), "en", "s", k) for k in range(6) for w in "ab"] + [(2, "short text", "en", "s", 0)] * 2
    kept = set()
    for n in (1, 3, 5):
        docs = spark.createDataFrame(rows[::-1] if n == 3 else rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        got = corpus_pipeline.near_duplicates(spark, docs, "unused")
        assert got.columns == docs.columns
        kept.add(tuple(sorted(map(tuple, got.collect()))))
    assert len(kept) == 1 and [r[0] for r in kept.pop()] == [1, 2]
