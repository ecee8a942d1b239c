"""Queries over events, labels, conversations, embeddings, pages and the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockquery.functions import bands, geometry, text
from blockquery.operators import evaluate, layout, ledger
from blockquery.session import table, texts

STEPS = ["click", "error", "purchase", "signup", "view"]
CELL = 0.25


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a ledger: user = run, type = step, value = duration; k of the properties gives the status."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("step_name"), F.col("ts").alias("started_at"), F.col("value").alias("duration_ms"), k.alias("k"),
        F.when(k % 10 == 0, "failed").when(k % 3 == 0, "started").otherwise("completed").alias("status"), F.when(k % 4 == 0, "hit").when(k % 4 == 1, "miss").alias("cache_status"),
    )


LEDGER = """ledger AS (SELECT user_id AS run_id, event_id, event_type AS step_name, ts AS started_at, value AS duration_ms, k,
  CASE WHEN k % 10 = 0 THEN 'failed' WHEN k % 3 = 0 THEN 'started' ELSE 'completed' END AS status, CASE WHEN k % 4 = 0 THEN 'hit' WHEN k % 4 = 1 THEN 'miss' END AS cache_status
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def ledger_rollup(spark, sf):
    return ledger.run_rollup(_events(spark, sf))


def step_timing_pivot(spark, sf):
    return ledger.step_timing_pivot(_events(spark, sf), STEPS)


def slowest_step(spark, sf):
    return ledger.slowest_step(_events(spark, sf))


def timeline_order(spark, sf):
    return ledger.timeline(_events(spark, sf))


def latest_run(spark, sf):
    return ledger.latest_run(_events(spark, sf))


def recover_abandoned(spark, sf):
    return ledger.recover_abandoned(_events(spark, sf))


def cooldown_gaps(spark, sf):
    return ledger.cooldown_gaps(_events(spark, sf), 60)


def cache_status_rollup(spark, sf):
    return ledger.cache_status(_events(spark, sf))


def audit_latest(spark, sf):
    return ledger.audit_latest(_events(spark, sf))


def error_classes(spark, sf):
    """Ordered message classes over a message made of status and step."""
    message = F.when(F.col("status") == "failed", F.concat(F.lit("Request timed out in "), "step_name")).when(F.col("status") == "started", F.lit("restart abort"))
    return _events(spark, sf).groupBy(ledger.error_classes(message).alias("error_class"), "step_name").agg(F.count("*").alias("n"))


def model_calls(spark, sf):
    """Calls, failures, tokens and skipped fields of each step."""
    e = _events(spark, sf)
    return e.groupBy("step_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.sum("k").alias("tokens"), F.sum(F.when(F.col("status") == "failed", F.greatest(F.lit(1), F.col("k") % 5))).alias("skipped_fields"), F.lit(0.0).alias("cost_usd")
    )


def event_windows(spark, sf):
    """Extension: hourly windows of the ledger (the batch twin of the streaming roll-up)."""
    return _events(spark, sf).groupBy(F.window("started_at", "1 hour")["start"].alias("hour"), "step_name").agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 4).alias("total_ms"))


def _eval_rows(spark, sf):
    """Gold quality and toxicity against predictions from simple features; documents without gold are not scored."""
    labels = table(spark, sf, "labels")
    gold = labels.select(F.col("doc_id").alias("case_id"), F.explode(F.array(F.struct(F.lit("quality").alias("f"), F.when(F.col("toxic") == 1, "unknown").otherwise(F.col("quality").cast("string")).alias("e")), F.struct(F.lit("toxic").alias("f"), F.col("toxic").cast("string").alias("e")))).alias("g")).select(
        "case_id", F.col("g.f").alias("field_key"), F.col("g.e").alias("expected")
    )
    docs = texts(spark, sf, "documents")
    quality = F.when(F.col("n_chars") > 1000, "1").when(F.col("n_chars") > 500, "unknown").otherwise("0")
    results = docs.select(F.col("doc_id").alias("case_id"), "lang", "n_chars", F.explode(F.array(F.struct(F.lit("quality").alias("f"), quality.alias("a")), F.struct(F.lit("toxic").alias("f"), F.lit("0").alias("a")))).alias("r")).select(
        "case_id", F.col("r.f").alias("field_key"), F.col("r.a").alias("actual"), (F.col("n_chars") % 3 != 0).alias("has_evidence"), (F.col("n_chars") > 2000).alias("auto_accepted"), "lang"
    )
    return evaluate.gold_vs_results(gold, results)


EVAL = """gold AS (SELECT doc_id AS case_id, 'quality' AS field_key, CASE WHEN toxic = 1 THEN 'unknown' ELSE CAST(quality AS VARCHAR) END AS expected FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels),
results AS (SELECT doc_id AS case_id, 'quality' AS field_key, CASE WHEN n_chars > 1000 THEN '1' WHEN n_chars > 500 THEN 'unknown' ELSE '0' END AS actual, n_chars % 3 <> 0 AS has_evidence, n_chars > 2000 AS auto_accepted, lang FROM documents
  UNION ALL SELECT doc_id, 'toxic', '0', n_chars % 3 <> 0, n_chars > 2000, lang FROM documents),
joined AS (SELECT * FROM gold LEFT JOIN results USING (case_id, field_key))"""


def _score_sql(by: str) -> str:
    known, gold = "(actual IS NOT NULL AND actual <> 'unknown')", "(expected <> 'unknown')"
    right = "coalesce(actual = expected, false)"
    return f"""WITH {EVAL}, c AS (SELECT {by}, count(*) AS total, count(*) FILTER ({right}) AS correct, count(*) FILTER ({right} AND {gold}) AS true_positive, count(*) FILTER ({known}) AS predicted_known,
    count(*) FILTER ({gold}) AS gold_known, count(*) FILTER ({known} AND NOT {gold}) AS misfill, count(*) FILTER ({known} AND has_evidence) AS covered, count(*) FILTER (auto_accepted) AS auto_accept, count(*) FILTER (auto_accepted AND {right}) AS auto_correct FROM joined GROUP BY {by})
    SELECT *, round(CASE WHEN total = 0 THEN 0 ELSE correct::DOUBLE / total END, 6) AS accuracy, round(CASE WHEN predicted_known = 0 THEN 0 ELSE true_positive::DOUBLE / predicted_known END, 6) AS precision,
    round(CASE WHEN gold_known = 0 THEN 0 ELSE true_positive::DOUBLE / gold_known END, 6) AS recall, round(CASE WHEN auto_accept = 0 THEN 0 ELSE auto_correct::DOUBLE / auto_accept END, 6) AS auto_accept_precision,
    round(CASE WHEN predicted_known = 0 THEN 1 ELSE covered::DOUBLE / predicted_known END, 6) AS evidence_coverage, round(CASE WHEN total = 0 THEN 0 ELSE misfill::DOUBLE / total END, 6) AS unknown_misfill_rate FROM c"""


def eval_case(spark, sf):
    return evaluate.case_score(_eval_rows(spark, sf), ["case_id"])


def eval_summary(spark, sf):
    return evaluate.case_score(_eval_rows(spark, sf).withColumn("run", F.lit("all")), ["run"])


def eval_by_tag(spark, sf):
    return evaluate.case_score(_eval_rows(spark, sf).where("lang is not null"), ["field_key", "lang"])


def eval_missing_cases(spark, sf):
    """Documents without gold become zero rows with an error code."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left_anti").select("doc_id", F.lit("CASE_NOT_PROCESSED").alias("error_code"), F.lit(0).alias("correct"))


def gold_symmetric_difference(spark, sf):
    """Ids on one side only, each with its side."""
    d, g = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return d.exceptAll(g).withColumn("side", F.lit("fixture")).unionAll(g.exceptAll(d).withColumn("side", F.lit("gold")))


def cer_by_page(spark, sf):
    """Character error rate of every sentence against a copy with each fifth character dropped; bands by document."""
    ascii_only = F.regexp_replace("text", "[^\\x20-\\x7e\\n]", "")
    lines = texts(spark, sf, "documents").select("doc_id", F.posexplode(F.split(ascii_only, "[\n.|]")).alias("page", "truth"))
    noisy = lines.select("doc_id", "page", F.regexp_replace("truth", "(....).", "$1").alias("text"))
    rates = evaluate.page_error_rates(noisy, lines)
    return rates.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.round(F.sum(F.col("cer") * F.greatest(F.length("truth"), F.lit(1))) / F.sum(F.greatest(F.length("truth"), F.lit(1))), 6).alias("cer"), F.count_if(bands.error_band5(F.col("cer")) == "poor").alias("n_poor")
    )


def weighted_metric(spark, sf):
    """Discount weighted by quantity; a null metric (returned lines) keeps its weight."""
    metric = F.when(F.col("l_returnflag") != "R", F.col("l_discount"))
    return table(spark, sf, "lineitem").groupBy("l_shipdate").agg(F.round(evaluate.weighted_mean(metric, F.col("l_quantity")), 6).alias("metric"), F.sum("l_quantity").alias("weight"))


def _boxes(spark, sf):
    """Four floats of a vector as a box, sorted on either axis; page by label."""
    e = F.transform("embedding", lambda x: F.round(x.cast("double"), 4))
    bbox = F.array(F.least(e[0], e[2]), F.least(e[1], e[3]), F.greatest(e[0], e[2]), F.greatest(e[1], e[3]))
    return table(spark, sf, "embeddings").select(F.col("label").alias("page"), F.col("vec_id").alias("box_id"), bbox.alias("bbox"), F.round(F.abs(e[4]), 4).alias("confidence"))


BOXES = """boxes AS (SELECT page, box_id, [least(e[1], e[3]), least(e[2], e[4]), greatest(e[1], e[3]), greatest(e[2], e[4])] AS bbox, round(abs(e[5]), 4) AS confidence
  FROM (SELECT label AS page, vec_id AS box_id, list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS e FROM embeddings))"""
_AREA = lambda b: f"(({b}[3] - {b}[1]) * ({b}[4] - {b}[2]))"
_INTER = "(greatest(least(a.bbox[3], b.bbox[3]) - greatest(a.bbox[1], b.bbox[1]), 0.0) * greatest(least(a.bbox[4], b.bbox[4]) - greatest(a.bbox[2], b.bbox[2]), 0.0))"


def bbox_iou_pairs(spark, sf):
    return layout.overlapping_pairs(_boxes(spark, sf).where(geometry.valid(F.col("bbox"))), CELL, 0.5)


def bbox_union(spark, sf):
    b = F.col("bbox")
    return _boxes(spark, sf).groupBy("page").agg(F.min(b[0]).alias("x1"), F.min(b[1]).alias("y1"), F.max(b[2]).alias("x2"), F.max(b[3]).alias("y2"), F.count("*").alias("n"), F.round(F.sum(geometry.area(b)), 6).alias("area"))


def dedupe_boxes(spark, sf):
    return layout.dedupe_boxes(_boxes(spark, sf).where(geometry.valid(F.col("bbox"))))


def same_line_fold(spark, sf):
    return layout.same_line_fold(_boxes(spark, sf), 0.02, 0.1)


def coordinate_space(spark, sf):
    return layout.coordinate_space(_boxes(spark, sf))


def calibrate_confidence(spark, sf):
    c = F.col("confidence")
    t = F.when(F.col("page") % 2 == 0, 1.5).otherwise(0.8)
    return _boxes(spark, sf).select("box_id", bands.calibrated(c, t).alias("calibrated"), bands.confidence_gate(bands.calibrated(c, t)).alias("gate"))


def dense_rows(spark, sf):
    """Rows of a page, 0.1 high, that hold three boxes or more."""
    row = F.floor((F.col("bbox")[1] + F.col("bbox")[3]) / 2 / 0.1).cast("int")
    return _boxes(spark, sf).groupBy("page", row.alias("row_band")).agg(F.count("*").alias("n"), F.min("box_id").alias("first_box")).where("n >= 3")


def box_medians(spark, sf):
    """Exact median and the upper-middle variant of positive widths."""
    w = F.round(F.col("bbox")[2] - F.col("bbox")[0], 4)
    values = F.array_sort(F.collect_list(F.when(w > 0, w)))
    return _boxes(spark, sf).groupBy("page").agg(F.round(F.median(w), 6).alias("median_width"), F.coalesce(F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int")), F.lit(1.0)).alias("upper_median"))


def context_neighbours(spark, sf):
    return layout.with_neighbours(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.md5(F.concat_ws("\n", "before", "text", "after")).alias("context_md5"), F.length(F.concat_ws("\n", "before", "text", "after")).alias("context_chars"))


def budgeted_context(spark, sf):
    return layout.running_budget(table(spark, sf, "conversations"), "conv_id", F.col("turn"), 800).select("conv_id", "turn", F.length("kept").alias("kept_chars"), F.md5("kept").alias("kept_md5"), "used")


def paragraph_islands(spark, sf):
    """Consecutive lines of a turn's document that continue a sentence form a paragraph."""
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    joins = (F.length("text") < 200) & (F.lag(F.length("text")).over(w) < 1000)
    i = layout.islands(c, "conv_id", "turn", joins)
    return i.groupBy("conv_id", "island").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("n_chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), "+").alias("roles"))


def page_text_concat(spark, sf):
    """Ordered concatenation of a conversation's non-blank turns."""
    parts = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("turn", "text"))))
    joined = F.array_join(F.transform(parts, lambda x: x["text"]), "\n")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.md5(joined).alias("text_md5"), F.length(joined).alias("n_chars"))


def config_integrity(spark, sf):
    """Dangling references as a violation table."""
    o, c, line, part, supplier = (table(spark, sf, t) for t in ("orders", "customer", "lineitem", "part", "supplier"))

    def dangling(rule: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
        return child.join(parent, child[key] == parent[parent_key], "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("long").alias("key")).distinct()

    found = [
        dangling("order_without_customer", o, "o_custkey", c, "c_custkey"),
        dangling("customer_without_order", c, "c_custkey", o, "o_custkey"),
        dangling("line_without_order", line, "l_orderkey", o, "o_orderkey"),
        dangling("part_without_line", part, "p_partkey", line, "l_partkey"),
        dangling("line_without_supplier", line, "l_suppkey", supplier, "s_suppkey"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def case_list_rollup(spark, sf):
    """Three grouped counts of a case, joined; closed cases leave the list."""
    o = table(spark, sf, "orders").where("o_orderstatus <> 'F'")
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("results"), F.count_if(F.col("l_returnflag") == "R").alias("review_required"), F.count_if(F.col("l_linestatus") == "O").alias("audits"))
    return o.join(line, "o_orderkey", "left").select("o_orderkey", F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("review_required", F.lit(0)).alias("review_required"), F.coalesce("audits", F.lit(0)).alias("audits"))


def runtime_contract(spark, sf):
    """Expected against observed rows, null-safe: four suppliers for each nation of a region."""
    nation = table(spark, sf, "nation")
    expected = nation.groupBy(F.col("n_regionkey").alias("k")).agg((F.count("*") * 4).alias("expected"))
    supplier = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    observed = supplier.groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("observed"))
    return expected.join(observed, "k", "full_outer").where(~F.col("expected").eqNullSafe(F.col("observed")))


def tile_starts(spark, sf):
    length = (F.col("p_size") * 40).cast("int")
    return table(spark, sf, "part").select("p_partkey", F.posexplode(layout.tile_starts(length, 512, 64)).alias("tile_no", "start"))


def table_cells_kv(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row")).agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.max("l_quantity").cast("int").cast("string").alias("quantity"))
    cells = rows.select("table_id", "row", F.posexplode(F.array("flag", "status", "quantity")).alias("col", "text"))
    return layout.row_cells(cells)


def html_payload_scan(spark, sf):
    """Headings, links, tags and visible words of every page, by expressions alone."""
    h = F.col("html")
    plain = F.regexp_replace(F.regexp_replace(h, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return texts(spark, sf, "pages").select("page_id", F.regexp_extract(h, "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_count(h, F.lit("(?i)<a\\s")).alias("n_links"), F.regexp_count(h, F.lit("<[a-zA-Z]")).alias("n_tags"), F.size(text.terms(plain)).alias("n_words"), F.regexp_extract("url", "^https?://([^/:]+)", 1).alias("host"))


def bigram_overlap(spark, sf):
    """Best document for each benchmark item by shared word pairs, both sides whole.

    Word pairs are joined after those of the documents are narrowed to the benchmark's, so the join is as large as the matches.
    """
    def pairs(df: DataFrame, key: str) -> DataFrame:
        words = text.terms(F.col("text"))
        couples = F.arrays_zip(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))
        two = F.array_distinct(F.transform(couples, lambda c: F.concat_ws(" ", c["a"], c["b"])))
        return df.select(F.col(key), F.size(two).alias("n"), F.explode(two).alias("pair"))

    items = pairs(table(spark, sf, "benchmark"), "item_id").withColumnRenamed("n", "n_item")
    docs = pairs(texts(spark, sf, "documents"), "doc_id")
    shared = docs.join(items, "pair").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"), F.first("n_item").alias("n_item"))
    score = F.col("shared") / F.col("n_item")
    return shared.groupBy("item_id").agg(F.min_by(F.struct("doc_id", F.round(score, 6).alias("score")), F.struct(-score, F.col("doc_id"))).alias("b"), F.count_if(score >= 0.22).alias("n_candidates")).select("item_id", "b.*", "n_candidates")


def text_similarity(spark, sf):
    """Sequence-matcher ratio of every page's title and the last part of its address."""
    from blockquery.functions.similarity import sequence_ratio

    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    slug = F.regexp_extract("url", "([^/]*)/?$", 1)
    return texts(spark, sf, "pages").select("page_id", F.round(sequence_ratio(title, slug), 6).alias("ratio"))


FN = {
    f.__name__: f
    for f in (
        ledger_rollup, step_timing_pivot, slowest_step, timeline_order, latest_run, recover_abandoned, cooldown_gaps, cache_status_rollup, audit_latest, error_classes, model_calls, event_windows,
        eval_case, eval_summary, eval_by_tag, eval_missing_cases, gold_symmetric_difference, cer_by_page, weighted_metric, bbox_iou_pairs, bbox_union, dedupe_boxes, same_line_fold, coordinate_space,
        calibrate_confidence, dense_rows, box_medians, context_neighbours, budgeted_context, paragraph_islands, page_text_concat, config_integrity, case_list_rollup, runtime_contract, tile_starts,
        table_cells_kv, html_payload_scan, bigram_overlap, text_similarity,
    )
}

_pivot = ", ".join(f"round(arg_max(CASE WHEN step_name = '{s}' THEN duration_ms END, CASE WHEN step_name = '{s}' THEN (started_at, event_id) END), 4) AS {s}_ms" for s in STEPS)
_cal = "round(1 / (1 + exp(-ln(q / (1 - q)) / t)), 6)"
_dangling = lambda rule, child, key, parent, pkey: f"SELECT DISTINCT '{rule}' AS rule, CAST({key} AS BIGINT) AS key FROM {child} WHERE NOT EXISTS (SELECT 1 FROM {parent} WHERE {pkey} = {key})"

SQL = {
    "ledger_rollup": f"WITH {LEDGER} SELECT run_id, count(*) AS n_events, count(*) FILTER (status = 'failed') AS n_failed, round(sum(duration_ms), 4) AS total_ms, round(max(duration_ms), 4) AS max_ms, round(count(*) FILTER (status = 'failed')::DOUBLE / count(*), 6) AS failed_rate, min(started_at) AS first_at, max(started_at) AS last_at FROM ledger GROUP BY 1",
    "step_timing_pivot": f"WITH {LEDGER} SELECT run_id, {_pivot}, count(*) AS n_events FROM ledger GROUP BY 1",
    "slowest_step": f"WITH {LEDGER} SELECT run_id, step_name, round(duration_ms, 4) AS duration_ms, event_id, n_slow FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY duration_ms DESC, event_id) AS rn, count(*) FILTER (duration_ms > 50) OVER (PARTITION BY run_id) AS n_slow FROM ledger) WHERE rn = 1",
    "timeline_order": f"WITH {LEDGER} SELECT run_id, event_id, step_name, CAST(row_number() OVER w AS INTEGER) AS place, row_number() OVER w = 1 AS latest FROM ledger WINDOW w AS (PARTITION BY run_id ORDER BY started_at DESC, event_id DESC)",
    "latest_run": f"WITH {LEDGER} SELECT run_id, event_id, step_name, status, started_at, n_events FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY run_id) AS n_events FROM ledger) WHERE rn = 1",
    "recover_abandoned": f"WITH {LEDGER} SELECT run_id, CASE WHEN status = 'started' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'started' THEN 'PROCESS_RESTART_ABORTED' END AS error_code, status = 'started' AS recovered FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, event_id DESC) AS rn FROM ledger) WHERE rn = 1",
    "cooldown_gaps": f"WITH {LEDGER}, g AS (SELECT run_id, event_id, epoch_us(started_at) - epoch_us(lag(started_at) OVER (PARTITION BY run_id ORDER BY started_at, event_id)) AS gap FROM ledger) SELECT run_id, event_id, coalesce(gap, -1) AS gap_us, coalesce(gap < 60000000, false) AS cooling FROM g",
    "cache_status_rollup": f"WITH {LEDGER} SELECT run_id, CASE WHEN count(cache_status) = 0 THEN 'not_applicable' WHEN bool_and(cache_status = 'hit') THEN 'hit' WHEN bool_or(cache_status = 'hit') THEN 'partial' WHEN bool_and(cache_status = 'miss') THEN 'miss' ELSE 'not_applicable' END AS cache_status, count(*) FILTER (cache_status = 'hit') AS n_hit, count(*) FILTER (cache_status = 'miss') AS n_miss FROM ledger GROUP BY 1",
    "audit_latest": f"WITH {LEDGER} SELECT run_id, step_name, event_id, status, round(duration_ms, 4) AS duration_ms, n - 1 AS n_before FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step_name ORDER BY started_at DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY run_id, step_name) AS n FROM ledger) WHERE rn = 1",
    "error_classes": f"WITH {LEDGER} SELECT CASE status WHEN 'failed' THEN 'timeout' WHEN 'started' THEN 'aborted' ELSE 'none' END AS error_class, step_name, count(*) AS n FROM ledger GROUP BY ALL",
    "model_calls": f"WITH {LEDGER} SELECT step_name, count(*) AS n, count(*) FILTER (status = 'failed') AS n_failed, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(CASE WHEN status = 'failed' THEN greatest(1, k % 5) END) AS BIGINT) AS skipped_fields, CAST(0 AS DOUBLE) AS cost_usd FROM ledger GROUP BY 1",
    "event_windows": f"WITH {LEDGER} SELECT time_bucket(INTERVAL 1 HOUR, started_at) AS hour, step_name, count(*) AS n, round(sum(duration_ms), 4) AS total_ms FROM ledger GROUP BY ALL",
    "eval_case": _score_sql("case_id"),
    "eval_summary": _score_sql("run").replace("FROM joined GROUP BY run", "FROM (SELECT 'all' AS run, * FROM joined) GROUP BY run"),
    "eval_by_tag": _score_sql("field_key, lang").replace("FROM joined GROUP", "FROM joined WHERE lang IS NOT NULL GROUP"),
    "eval_missing_cases": "SELECT doc_id, 'CASE_NOT_PROCESSED' AS error_code, 0 AS correct FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "gold_symmetric_difference": "(SELECT doc_id, 'fixture' AS side FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'gold' AS side FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents))",
    "cer_by_page": r"WITH l AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '[^\x20-\x7e\n]', '', 'g'), '[\n.|]')) AS truth FROM documents), n AS (SELECT doc_id, truth, regexp_replace(truth, '(....).', '\1', 'g') AS text FROM l), r AS (SELECT doc_id, truth, CASE WHEN length(truth) = 0 THEN CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE least(1.0::DOUBLE, levenshtein(text, truth)::DOUBLE / greatest(length(truth), 1)) END AS cer FROM n) SELECT doc_id, count(*) AS n_pages, round(sum(cer * greatest(length(truth), 1)) / sum(greatest(length(truth), 1)), 6) AS cer, count(*) FILTER (cer > 0.10 AND cer <= 0.25) AS n_poor FROM r GROUP BY 1",
    "weighted_metric": "SELECT l_shipdate, round(sum(coalesce(CASE WHEN l_returnflag <> 'R' THEN l_discount END, 0.0) * l_quantity) / sum(l_quantity), 6) AS metric, sum(l_quantity) AS weight FROM lineitem GROUP BY 1",
    "bbox_iou_pairs": f"WITH {BOXES}, v AS (SELECT * FROM boxes WHERE bbox[3] > bbox[1] AND bbox[4] > bbox[2]), p AS (SELECT a.page, a.box_id AS a, b.box_id AS b, {_INTER} / ({_AREA('a.bbox')} + {_AREA('b.bbox')} - {_INTER}) AS iou FROM v a JOIN v b ON a.page = b.page AND a.box_id < b.box_id) SELECT page, a, b, round(iou, 6) AS iou FROM p WHERE iou >= 0.5",
    "bbox_union": f"WITH {BOXES} SELECT page, min(bbox[1]) AS x1, min(bbox[2]) AS y1, max(bbox[3]) AS x2, max(bbox[4]) AS y2, count(*) AS n, round(sum(CASE WHEN bbox[3] > bbox[1] AND bbox[4] > bbox[2] THEN {_AREA('bbox')} ELSE 0 END), 6) AS area FROM boxes GROUP BY 1",
    "coordinate_space": f"WITH {BOXES}, t AS (SELECT *, greatest(max(bbox[3]) OVER w, max(bbox[4]) OVER w) AS top FROM boxes WINDOW w AS (PARTITION BY page)), s AS (SELECT *, CASE WHEN top <= 1.5 THEN 'unit' WHEN top <= 100 AND top > 50 THEN 'percent' WHEN top <= 1000 THEN 'per_mille' ELSE 'image' END AS space FROM t), f AS (SELECT *, CASE space WHEN 'unit' THEN 100.0::DOUBLE WHEN 'percent' THEN 1.0::DOUBLE WHEN 'per_mille' THEN 0.1::DOUBLE ELSE 100.0::DOUBLE / top END AS scale FROM s) SELECT page, box_id, space, round(least(greatest(bbox[1] * scale, 0.0), 100.0), 6) AS left_pct, round(greatest((bbox[3] - bbox[1]) * scale, 0.25), 6) AS width_pct FROM f",
    "calibrate_confidence": f"WITH {BOXES}, q AS (SELECT box_id, least(greatest(confidence, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS q, CASE WHEN page % 2 = 0 THEN 1.5::DOUBLE ELSE 0.8::DOUBLE END AS t FROM boxes), c AS (SELECT box_id, {_cal} AS calibrated FROM q) SELECT *, CASE WHEN calibrated >= 0.9 THEN 'accept' WHEN calibrated >= 0.5 THEN 'review' ELSE 'reject' END AS gate FROM c",
    "dense_rows": f"WITH {BOXES} SELECT page, CAST(floor((bbox[2] + bbox[4]) / 2 / 0.1::DOUBLE) AS INTEGER) AS row_band, count(*) AS n, min(box_id) AS first_box FROM boxes GROUP BY 1, 2 HAVING count(*) >= 3",
    "box_medians": f"WITH {BOXES}, w AS (SELECT page, round(bbox[3] - bbox[1], 4) AS w FROM boxes), l AS (SELECT page, median(w) AS m, list_sort(list(w) FILTER (w > 0)) AS v FROM w GROUP BY 1) SELECT page, round(m, 6) AS median_width, coalesce(v[len(v) // 2 + 1], 1.0) AS upper_median FROM l",
    "context_neighbours": "WITH c AS (SELECT conv_id, turn, concat_ws(chr(10), lag(text) OVER w, text, lead(text) OVER w) AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, md5(t) AS context_md5, CAST(length(t) AS INTEGER) AS context_chars FROM c",
    "budgeted_context": "WITH u AS (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM conversations), k AS (SELECT *, CASE WHEN length(text) > 800 - used THEN left(text, greatest(800 - used - 3, 0)) || '...' ELSE text END AS kept FROM u WHERE used < 800) SELECT conv_id, turn, CAST(length(kept) AS INTEGER) AS kept_chars, md5(kept) AS kept_md5, used FROM k",
    "paragraph_islands": "WITH j AS (SELECT *, coalesce(length(text) < 200 AND lag(length(text)) OVER w < 1000, false) AS j FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, CAST(sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM j) SELECT conv_id, island, count(*) AS n_turns, min(turn) AS first_turn, CAST(sum(length(text)) AS BIGINT) AS n_chars, string_agg(role, '+' ORDER BY turn) AS roles FROM i GROUP BY 1, 2",
    "page_text_concat": "SELECT conv_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS t FROM conversations GROUP BY 1)",
    "config_integrity": " UNION ALL ".join(
        _dangling(*x)
        for x in (("order_without_customer", "orders", "o_custkey", "customer", "c_custkey"), ("customer_without_order", "customer", "c_custkey", "orders", "o_custkey"), ("line_without_order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("part_without_line", "part", "p_partkey", "lineitem", "l_partkey"), ("line_without_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"))
    ),
    "case_list_rollup": "WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) AS results, count(*) FILTER (l_returnflag = 'R') AS review_required, count(*) FILTER (l_linestatus = 'O') AS audits FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(results, 0) AS results, coalesce(review_required, 0) AS review_required, coalesce(audits, 0) AS audits FROM orders LEFT JOIN l USING (o_orderkey) WHERE o_orderstatus <> 'F'",
    "runtime_contract": """WITH o AS (SELECT n_regionkey AS k, count(*) AS observed FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
        e AS (SELECT n_regionkey AS k, 4 * count(*) AS expected FROM nation GROUP BY 1) SELECT k, expected, observed FROM e FULL JOIN o USING (k) WHERE expected IS DISTINCT FROM observed""",
    "tile_starts": "WITH p AS (SELECT p_partkey, p_size * 40 AS n FROM part), f AS (SELECT p_partkey, greatest(n - 512, 0) AS flush FROM p), s AS (SELECT p_partkey, list_sort(list_distinct(list_concat(list_filter(range(0, flush + 1, 448), lambda x: x <= flush), [flush]))) AS v FROM f) SELECT p_partkey, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS tile_no, CAST(unnest(v) AS INTEGER) AS start FROM s",
    "table_cells_kv": "WITH c AS (SELECT l_orderkey AS table_id, l_linenumber AS row, unnest([0, 1, 2]) AS col, unnest([max(l_returnflag), max(l_linestatus), CAST(CAST(max(l_quantity) AS INTEGER) AS VARCHAR)]) AS text FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT table_id, row, col, text AS key, lead(text) OVER (PARTITION BY table_id, row ORDER BY col) AS right_value, last_value(text) OVER (PARTITION BY table_id, col ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below_value FROM c",
    "html_payload_scan": r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\s')) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(html, '<[a-zA-Z]')) AS INTEGER) AS n_tags, CAST(len(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS INTEGER) AS n_words, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages",
    "bigram_overlap": r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), wu AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), wl AS (SELECT doc_id, x || ' ' || lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS pair FROM wu), d AS (SELECT DISTINCT doc_id, pair FROM wl WHERE pair IS NOT NULL), v AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark), vu AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM v), vl AS (SELECT item_id, x || ' ' || lead(x) OVER (PARTITION BY item_id ORDER BY i) AS pair FROM vu), b AS (SELECT DISTINCT item_id, pair FROM vl WHERE pair IS NOT NULL), n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1), s AS (SELECT item_id, doc_id, count(*) AS shared FROM d JOIN b USING (pair) GROUP BY ALL), r AS (SELECT item_id, doc_id, shared::DOUBLE / n_item AS score FROM s JOIN n USING (item_id)) SELECT item_id, doc_id, round(score, 6) AS score, n_candidates FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn, count(*) FILTER (score >= 0.22) OVER (PARTITION BY item_id) AS n_candidates FROM r) WHERE rn = 1",
}
