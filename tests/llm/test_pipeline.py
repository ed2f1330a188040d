import numpy as np

import corpus_pipeline


def test_stages(spark, sf1):
    docs, counts = spark.read.parquet(f"{sf1}/documents.parquet"), []
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf1)
        assert sorted(out.columns) == sorted(corpus_pipeline.COLUMNS)
        counts.append(out.count())
        docs = out
    assert docs.count() > 700 and counts == sorted(counts, reverse=True) and counts[0] < 1000


def test_run_packs_what_the_stages_keep(spark, sf1):
    rows = corpus_pipeline.run(spark, sf1).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").toPandas()
    assert (rows.groupby("doc_id").length.sum() == rows.groupby("doc_id").doc_tokens.first()).all()
    ends = rows.assign(end=rows.offset + rows.length).groupby("sequence_id").agg(total=("length", "sum"), end=("end", "max"))
    assert (ends.total == ends.end).all() and (ends.total <= 2048).all() and np.log2(ends.total).mod(1).eq(0).all()


def test_stages_take_odd_tables(spark, odd, none, tmp_path):
    spark.createDataFrame([(5, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        docs = docs.withColumn("n_chars", docs.doc_id)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.count()
            docs = out if "text" in out.columns else docs
