from pyspark.sql import functions as F

import corpus_pipeline
from tradewind.llm.simhash import simhash_dedup
from tradewind.session import materialise

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "near_duplicates":
            wanted = {r.component_id for r in simhash_dedup(before).select("component_id").collect()}
            assert ids == wanted and counts[-1] == len(wanted)
    assert counts[0] > counts[1] >= counts[2] > counts[3]
    places = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    rows = sorted(places.collect(), key=lambda r: r.start)
    assert len(rows) == counts[-1]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r) for r in rows)


def test_stages_take_odd_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(20).unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumns(
        {c: F.lit(None).cast(t) for c, t in docs.dtypes})).withColumns({"hash": F.lit("x"), "copies": F.lit("y"), "score": F.lit(1), "__id": F.lit("KEEP"),
        "__key": F.lit(2), "row": F.lit(3), "key": F.lit("k"), "place": F.lit(4), "copy": F.lit(5), "id": F.lit("i")})
    for table in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = materialise(stage(spark, table, SF), name)
            assert table.columns == odd.columns
            assert table.where("`__id` != 'KEEP' or `__key` != 2 or row != 3 or key != 'k' or id != 'i'").count() == 0
        corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
