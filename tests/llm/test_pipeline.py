import corpus_pipeline
from tillroll.llm import decontamination, passages, shingle_join
from tillroll.sources.scratch import written

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] // 2
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.contamination(docs, items)[1].count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_run_is_the_stages_one_after_the_other(spark):
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.columns[:2] == ["doc_id", "start"]
    rows = pieces.collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_nothing_is_left_to_remove(spark):
    docs = written(spark.read.parquet(f"{SF}/documents.parquet"), "documents")
    once = written(shingle_join.one_per_group(docs), "once")
    assert shingle_join.one_per_group(once).count() == once.count()
    cut = written(passages.without_repeats(once), "cut")
    words = passages.repeated_passages(cut)[1].collect()
    assert len(words) <= passages.repeated_passages(once)[1].count() // 10
