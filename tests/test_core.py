"""Reference operators on literal rows."""

from pyspark.sql import functions as F

from blockquery.functions import bands, geometry, text
from blockquery.operators import evaluate, evidence, layout, ledger, ocr
from blockquery.plans import recognition
from blockquery.sources.blocks import markdown_blocks, text_blocks


def _docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_blocks_split_by_blank_lines_else_by_lines(spark):
    rows = text_blocks(_docs(spark, "a\r\nb\r\n\r\n c ", "x\n y \n", "", None)).orderBy("doc_id", "reading_order").collect()
    assert [(r.doc_id, r.reading_order, r.text) for r in rows] == [(0, 1, "a\nb"), (0, 2, "c"), (1, 1, "x"), (1, 2, "y")]
    assert rows[0].block_id.startswith("b0001-") and rows[0].confidence == 0.98


def test_markdown_blocks_strip_prefixes_and_drop_separators(spark):
    rows = markdown_blocks(_docs(spark, "# Title\n- item\n|a|b|\n|---|---|\n2. two")).orderBy("line_no").collect()
    assert [(r.text, r.block_type) for r in rows] == [("Title", "title"), ("item", "paragraph"), ("a | b", "table"), ("two", "paragraph")]


def test_redaction_findings_and_masks(spark):
    row = _docs(spark, "mail a.b@c.org from 10.0.0.1, token = \"abcdef0123\"").select(
        text.redacted(F.col("text")).alias("r"), text.blocking_findings(F.col("text")).alias("f"), text.masked_secrets(F.col("text"), 500).alias("m")
    ).first()
    assert row.r.startswith("mail [EMAIL] from [IP]") and row.f == ["email", "ip"] and "abcdef0123" not in row.m


def test_noise_filter_sees_whole_texts(spark, tmp_path):
    body = "\n\n".join(["123 apples in a basket", "x" * 200, "77", "word"])
    _docs(spark, body).selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.reading_order for r in recognition.noise_filter(spark, str(tmp_path)).collect()) == [1, 2, 4]
    boxes = spark.createDataFrame([("tiny", "text", [0.0, 0.0, 2000.0, 100.0]), ("label", "text", [0.0, 0.0, 2000.0, 100.0]), ("12", "cell", [0.0, 0.0, 9.0, 9.0])], "text string, block_type string, bbox array<double>")
    assert {r.text for r in ocr.noise_filter(boxes).collect()} == {"label", "12"}


RULES = [evidence.Rule("code", 1, "[0-9]+", 0, 0.9)]


def _decide(spark, body, **policy):
    docs = spark.createDataFrame([(1, body, "en", "src1")], "doc_id long, text string, lang string, source string")
    blocks = text_blocks(docs, "lang", "source")
    policies = [evidence.Policy("code", policy.get("conflict", True), (), policy.get("allowed", ("integer",)))]
    decided = evidence.adjudicate(docs, evidence.rule_evidence(blocks, RULES), policies)
    return decided.first(), evidence.validate_guardrails(decided, blocks, policies).first()


def test_adjudication_missing_conflict_pass(spark):
    assert _decide(spark, "none")[0].decision_status == "MISSING"
    assert _decide(spark, "1 and 2")[0].decision_status == "CONFLICT"
    decision, guarded = _decide(spark, "only 7")
    assert (decision.decision_status, decision.code, decision.confidence) == ("PASS", "7", 0.98)
    assert guarded.auto_accepted and guarded.validation_state == "accepted"


def test_guardrail_rejects_invalid_code(spark):
    guarded = _decide(spark, "only 7", allowed=("8",))[1]
    assert (guarded.code, guarded.error_code, guarded.confidence, guarded.validation_state) == ("unknown", "INVALID_CODE", 0.3, "rejected")


def test_priority_is_substring_of_place(spark):
    df = spark.createDataFrame([("src10 en",), ("src3 de",)], "p string")
    ranks = [r.k for r in df.select(evidence.priority_rank(F.col("p"), F.array(F.lit("src1"), F.lit("de"))).alias("k")).collect()]
    assert ranks == [0, 1]


def test_evaluation_ratios(spark):
    rows = [(1, "f", "1", "1", True, True), (1, "g", "unknown", "0", False, False), (1, "h", "0", None, None, None)]
    joined = spark.createDataFrame(rows, "case_id long, field_key string, expected string, actual string, has_evidence boolean, auto_accepted boolean")
    r = evaluate.case_score(joined, ["case_id"]).first()
    assert (r.total, r.correct, r.misfill, r.gold_known, r.covered) == (3, 1, 1, 2, 1)
    assert (r.accuracy, r.evidence_coverage) == (0.333333, 0.5)


def test_error_rate_of_empty_references(spark):
    df = spark.createDataFrame([("", ""), ("a", ""), ("ab", "abcd")], "h string, r string")
    assert [x.c for x in df.select(text.char_error_rate(F.col("h"), F.col("r")).alias("c")).collect()] == [0.0, 1.0, 0.5]


def test_geometry(spark):
    df = spark.createDataFrame([([0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 3.0, 3.0])], "a array<double>, b array<double>")
    r = df.select(F.round(geometry.iou(F.col("a"), F.col("b")), 6).alias("i"), geometry.containment(F.col("a"), F.col("b")).alias("c"), bands.confidence_gate(F.lit(0.6)).alias("g")).first()
    assert (r.i, r.c, r.g) == (0.142857, 0.25, "review")


def test_grid_pairs_equal_all_pairs(spark):
    import random

    draw = random.Random(3)
    boxes = [(0, i, sorted(draw.uniform(-1, 1) for _ in range(2)), sorted(draw.uniform(-1, 1) for _ in range(2))) for i in range(40)]
    rows = [(p, i, [x[0], y[0], x[1], y[1]]) for p, i, x, y in boxes]
    found = layout.overlapping_pairs(spark.createDataFrame(rows, "page int, box_id long, bbox array<double>"), 0.25, 0.3)

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        i = max(w, 0) * max(h, 0)
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    assert {(r.a, r.b) for r in found.collect()} == {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and iou(a[2], b[2]) >= 0.3}


def test_recovery_twice_changes_nothing(spark):
    rows = [(1, 1, "s", "started", 1.0, 5), (2, 2, "s", "completed", 1.0, 5)]
    events = spark.createDataFrame(rows, "run_id long, event_id long, step_name string, status string, duration_ms double, started_at long")
    once = ledger.recover_abandoned(events)
    assert {(r.run_id, r.status, r.recovered) for r in once.collect()} == {(1, "failed", True), (2, "completed", False)}
    again = once.select("run_id", F.lit(9).cast("long").alias("event_id"), F.lit("s").alias("step_name"), "status", F.lit(1.0).alias("duration_ms"), F.lit(6).alias("started_at"))
    assert ledger.recover_abandoned(again).where("recovered").count() == 0


def test_tiles_end_flush(spark):
    df = spark.createDataFrame([(500,), (1000,)], "n int")
    assert [list(r.t) for r in df.select(layout.tile_starts(F.col("n"), 512, 64).alias("t")).collect()] == [[0], [0, 448, 488]]


def test_streaming_rollup_matches_batch(spark, tmp_path):
    from blockquery.streaming.ledger_stream import ingest_runs

    rows = [(1, 1, "a", "started", 1), (1, 2, "a", "completed", 2), (2, 3, "a", "started", 3)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "run_id long, event_id long, step_name string, status string, started_at long").repartition(3).write.parquet(src)
    ingest_runs(spark, src, out, str(tmp_path / "ck"), files_per_trigger=1)
    ingest_runs(spark, src, out, str(tmp_path / "ck"), files_per_trigger=1)
    got = {(r.run_id, r.status) for r in spark.read.parquet(out).groupBy("run_id").agg(F.max_by("status", F.struct("started_at", "event_id")).alias("status")).collect()}
    assert got == {(1, "completed"), (2, "started")} and spark.read.parquet(out).count() == 3


def test_every_catalogue_query_has_a_name_and_most_have_sql():
    from blockquery.plans import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.oracle_sql()) > 50
