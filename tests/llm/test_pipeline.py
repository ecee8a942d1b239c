"""The pipeline's stages on a small table: decisions take effect and clean documents stay."""

import corpus_pipeline
from blockquery.llm import jaccard_join


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import random

    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    prose = [" ".join(draw.choice(words) for _ in range(80)) for _ in range(12)]
    item = " ".join(draw.choice(words) for _ in range(30))
    texts = [*prose, prose[0], prose[1] + " more", None, "12 34", prose[2][:200] + " " + item, "secret=abcdef012345 " + prose[3][:150]]
    rows = [(i, t, "en" if i % 2 else "de", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), f"test-{name}")
        if name != "pieces":
            assert docs.columns == before
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] == set(range(18)) - {14, 15}
    assert kept[1] == kept[0] - {12, 13}
    assert kept[2] == kept[1] - {16} and kept[3] == kept[4] == kept[2]
    assert all(r.parity and r.decoded_ok for r in docs.collect())


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f g", "x", "s", 1)] * 2 + [(None, "a b c d e f g", "x", "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in jaccard_join.keep_representatives(frame).collect()) == ["1", "None"]


def test_written_tables_return_the_drivers_garbage(spark, monkeypatch):
    """Each written table has the driver collect and trim, if the last time is long enough ago."""
    from blockquery import session

    said, real = [], session.give_back
    monkeypatch.setattr(session, "give_back", lambda s: said.append(real(s)))
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    used = lambda: (runtime.totalMemory() - runtime.freeMemory()) >> 20
    left = spark.sparkContext._jvm.java.nio.ByteBuffer.allocate(200 << 20)
    before = used()
    spark.sparkContext._gateway.detach(left)
    for seconds in (0.0, 3600.0):
        monkeypatch.setattr(session, "GIVE_BACK_EVERY", seconds)
        assert session.stored(spark.range(7), "given-back").count() == 7
    assert said == [True, False]
    assert used() < before - 150
