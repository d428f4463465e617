"""The pipeline on the small tables: every stage keeps what it should."""

import corpus_pipeline
from corpusbench.llm import jaccard
from corpusbench.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs, names = start, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), f"test-{name}")
        names.append(name)
        if name != "packing":
            assert docs.columns == start.columns and 0 < docs.count() <= before.count()
            assert docs.count() == docs.select("doc_id").distinct().count()
        if name == "near_copies":
            groups = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(before).collect()}
            assert {r["doc_id"] for r in docs.collect()} == {k for k, v in groups.items() if k == v}
        if name == "repeated_strings":
            seen = set()
            for r in sorted(docs.join(before.select("doc_id", before["text"].alias("whole")), "doc_id").collect(), key=lambda r: r["doc_id"]):
                assert r["n_chars"] == len(r["text"]) <= len(r["whole"])
                strings = {r["whole"].encode()[i : i + 100] for i in range(len(r["whole"].encode()) - 99)}
                assert (r["text"] == r["whole"]) or strings & seen or len(strings) < len(r["whole"].encode()) - 99
                seen |= strings
            assert docs.count() == before.count()
    assert names == [n for n, _ in corpus_pipeline.STAGES] and {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
