import corpus_pipeline
from spanforge.llm.exact_dedup import exact_dedup
from spanforge.llm.near_dup import jaccard_join
from spanforge.llm.quality import quality_rules

from .helpers import documents, prose
from .test_near_dup import family, plain
from .test_repeats import plain_words


def test_stages(spark, tmp_path):
    texts = [*prose(11, 30), *family(4, 30, 90), *family(4, 10, 90)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == names, name
            out.write.parquet(f"{tmp_path}/out{k}")
            out = spark.read.parquet(f"{tmp_path}/out{k}")
        after = {r["doc_id"]: r["text"] for r in out.collect()} if k < 4 else None
        if k == 0:
            assert after == {r["doc_id"]: before[r["doc_id"]] for r in quality_rules(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("kept").collect()}
        elif k == 1:
            assert after == {r["doc_id"]: before[r["doc_id"]] for r in exact_dedup(docs).where("kept").collect()}
        elif k == 2:
            assert after == {i: before[i] for i, _, c in plain(sorted(before.items())) if i == c}
            assert len(after) < len(before)
        elif k == 3:
            want = {i: kept.decode() if gone else before[i] for i, _, gone, kept in plain_words(sorted(before.items()), 50)}
            assert after == want
            assert all(r["n_chars"] == len(r["text"]) or r["text"] == before[r["doc_id"]] for r in out.collect())
        else:
            assert {r["doc_id"] for r in out.collect()} == set(before)
        docs, before = out, after
    assert jaccard_join(documents(spark, [])).collect() == []


def test_near_dedup_by_row(spark, tmp_path):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    kept = lambda rows: sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near(spark, documents(spark, rows), str(tmp_path)).collect())
    assert kept([(3, one), (7, one + " tail"), (7, two)]) == [(3, one), (7, two)]
    assert kept([(5, one), (5, one), (8, two)]) == [(5, one), (8, two)]
    assert len(kept([(5, one), (5, one + " tail"), (8, two)])) == 2
    assert len(kept([(None, one), (None, one + " tail"), (None, two), (None, ""), (None, "")])) == 4


def test_empty(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_exact_dedup_by_row(spark, tmp_path):
    """Of equal rows one stays; columns whose names the stages use themselves do no harm."""
    rows = [(5, "a b"), (5, "a  b"), (5, "a b"), (7, "a b"), (8, "c"), (None, "c"), (None, None), (None, "")]
    docs = documents(spark, rows).selectExpr("*", "1 AS _row", "2 AS _dropped", "3 AS lead", "4 AS `x.y`")
    out = corpus_pipeline.exact(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or 0, (r["text"] or "").split()) for r in out.collect())
    assert got == [(0, []), (5, ["a", "b"]), (8, ["c"])]


def test_run_with_repeated_ids(spark, tmp_path):
    """The whole run: of copies and near copies one row stays, unrelated rows that share an id or have none stay too."""
    texts = [" ".join(f"{c}{i}" for i in range(120)) for c in "abcd"]
    rows = [(2, texts[0]), (2, texts[0]), (4, texts[0].upper()), (4, texts[1]), (4, texts[1] + " tail"), (None, texts[2]), (None, texts[3]), (9, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count()
    got = sorted((r["doc_id"] or 0) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect())
    assert kept == 7 and got == [0, 0, 2, 4]
