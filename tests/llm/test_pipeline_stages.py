"""Every pipeline stage on the rows of the one before."""

import corpus_pipeline
from flowmill.llm import bpe, decontaminate, minhash, quality
from flowmill.llm.queries import byte_vocabulary


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    counts, columns = [docs.count()], docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        counts.append(docs.count())
        if number < 4:
            assert docs.columns == columns
        if number == 0:
            bad = labels.where("quality = 0").join(docs, "doc_id").count()
            good = labels.where("quality = 1").join(docs, "doc_id", "left_anti").count()
            assert bad <= 1 and good <= 1
        if number == 1:
            assert counts[1] == counts[2] and docs.where("n_chars <> length(text)").count() == 0
        if number == 2:
            assert minhash.near_duplicates(docs).where("not kept").count() == 0
        if number == 3:
            assert decontaminate.find_contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
            want = {r.doc_id: r.text for r in docs.collect()}
    got = docs.collect()
    assert counts[-1] == counts[-2] == len(want) and len(got) == len(want)
    import hashlib
    assert all(r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest() for r in got)


def test_run_gives_the_stages_rows(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 50
