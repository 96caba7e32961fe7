import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline as P
    from karst.llm import decontaminate, minhash, pii
    from karst.llm.pieces import pieces

    assert [n for n, _ in P.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii", "sentencepiece_encoding"]
    docs, counts = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if i < 4:
            assert docs.dtypes == before.dtypes
        if i == 1:
            assert minhash.near_duplicates(docs).where("not kept").count() == 0
        if i == 2:
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
            clean = docs
        if i == 3:
            assert pii.find_pii(docs).where(F.size("pii") > 0).count() == 0 and docs.count() == clean.count()
            texts = {r.doc_id: r.text for r in docs.collect()}
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    import public_tokenizers

    p = pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: p.decode(r.ids) for r in docs.collect()} == texts
    assert {r.doc_id for r in P.run(spark, DATA).collect()} == set(texts)


def odd_docs(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", "s", 3), (4, "one", "en", "s", 3), (5, "mail a@b.cc now", "en", "s", 15), (6, "same words " * 40, "en", "s", 440), (6, "same words " * 40, "en", "s", 440), (None, "no id at all", "en", "s", 12), (None, None, None, None, None), (8, "x " * 30000, "en", "s", 60000), (9, "y" * 50000, "xx", "s", 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'a' as score", "1 as predicted", "true as kept", "'b' as pii", "doc_id as component_id", "text as ids", "2 as item_id")


def test_each_stage_on_odd_rows_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as P

    docs = odd_docs(spark)
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, DATA)
        rows = out.collect()
        if i < 4:
            assert out.dtypes == docs.dtypes, name
            assert {(r.doc_id, r.score) for r in rows} <= {(r.doc_id, "a") for r in docs.collect()}, name
        if name == "minhash_near_dedup":
            assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 1, 2, 3, 4, 5, 6, 8, 9]
        if name == "benchmark_decontamination":
            assert len(rows) == docs.count()
        if name == "pii":
            assert {r.text for r in rows if r.doc_id == 5} == {"mail [EMAIL] now"} and len(rows) == docs.count()
        if name == "sentencepiece_encoding":
            assert out.columns == ["doc_id", "ids", "n_ids"] and len(rows) == docs.count() and all(r.n_ids == len(r.ids) for r in rows)


def test_each_stage_on_an_empty_table(spark):
    import corpus_pipeline as P

    docs = odd_docs(spark).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, DATA).collect() == []
