"""Queries over ``documents``: blocks, redaction, evidence, decisions, packs, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockquery.functions import bands, text
from blockquery.operators import evidence
from blockquery.operators.evidence import Policy, Rule
from blockquery.plans.sqlparts import PARTS
from blockquery.session import table, texts
from blockquery.sources.blocks import markdown_blocks, text_blocks

# Fixed values of the neutral profile.
RULES = (
    Rule("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0, 0.92),
    Rule("ip", 2, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0, 0.92),
    Rule("token", 3, 'token = "([0-9a-f]+)"', 1, 0.95),
    Rule("card", 4, r"[0-9]{16}", 0, 0.9),
    Rule("license", 5, r"(?i)licen[sc]e", 0, 0.8),
)
POLICIES = (
    Policy("email", True, ("src1", "src2"), ("text",)),
    Policy("ip", False, ("en", "de"), ("text",)),
    Policy("token", True, (), ("text",), True),
    Policy("card", False, ("src0",), ("integer",)),
    Policy("license", False, (), ("license",)),
)
TERMS = (("licence", "free", "free", 0.8), ("licence", "license", "license", 0.9), ("contact", "mail", "@", 0.7), ("contact", "phone", "phone", 0.6), ("contact", "web", "http", 0.6))
QUERY_TERMS = ("the", "license", "of", "password", "token")
SECTION = r"(?i)licen[sc]e|copyright"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return text_blocks(texts(spark, sf, "documents"), "lang", "source")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.rule_evidence(_blocks(spark, sf), RULES)


def _rule_sql(r: Rule) -> str:
    return (
        f"SELECT doc_id, lang, source, reading_order, block_id, '{r.field_key}' AS field_key, {r.rule_no} AS rule_no, CAST({r.confidence} AS DOUBLE) AS rule_confidence, "
        f"unnest(regexp_extract_all(text, '{r.pattern}', {r.group})) AS evidence_text, generate_subscripts(regexp_extract_all(text, '{r.pattern}', {r.group}), 1) AS match_no FROM blocks"
    )


CANDIDATES = PARTS + ", candidates AS (SELECT *, lower(evidence_text) AS code, CAST(0.98 AS DOUBLE) AS confidence FROM (" + " UNION ALL ".join(map(_rule_sql, RULES)) + "))"


def _rank_sql(p: Policy) -> str:
    if not p.source_priority:
        return f"WHEN field_key = '{p.field_key}' THEN 0"
    inner = " ".join(f"WHEN contains(source || ' ' || lang, '{x}') THEN {i}" for i, x in enumerate(p.source_priority))
    return f"WHEN field_key = '{p.field_key}' THEN CASE {inner} ELSE {len(p.source_priority)} END"


RANKED = CANDIDATES + (
    ", ranked AS (SELECT *, greatest(rule_confidence, confidence) AS effective_confidence, CASE " + " ".join(map(_rank_sql, POLICIES)) + " END AS priority_rank FROM candidates), "
    "selected AS (SELECT doc_id, field_key, evidence_text, code, block_id, priority_rank, rule_confidence, effective_confidence, n_codes FROM ("
    "SELECT *, row_number() OVER (PARTITION BY doc_id, field_key ORDER BY priority_rank, effective_confidence DESC, confidence DESC, rule_no, reading_order, match_no) AS rn FROM ranked) r "
    "JOIN (SELECT doc_id, field_key, count(DISTINCT code) AS n_codes FROM candidates GROUP BY ALL) c USING (doc_id, field_key) WHERE rn = 1)"
)


def _allowed_sql(p: Policy) -> str:
    tests = []
    for a in p.allowed:
        tests.append("code <> 'unknown'" if a in ("text", "duration") else "regexp_matches(code, '^[0-9]+$')" if a == "integer" else f"code = '{a}'")
    return f"WHEN field_key = '{p.field_key}' THEN ({' OR '.join(tests) or 'true'})"


ALLOWED = "CASE " + " ".join(map(_allowed_sql, POLICIES)) + " END"
_VISUAL = ", ".join(f"'{p.field_key}'" for p in POLICIES if p.visual)
_CONFLICT = ", ".join(f"'{p.field_key}'" for p in POLICIES if p.review_conflict)
_FIELDS = ", ".join(f"'{p.field_key}'" for p in POLICIES)
DECIDED = RANKED + f"""
, wanted AS (SELECT doc_id, unnest([{_FIELDS}]) AS field_key FROM documents)
, judged AS (SELECT w.doc_id, w.field_key, s.* EXCLUDE (doc_id, field_key),
    concat_ws(',', CASE WHEN w.field_key IN ({_VISUAL}) THEN 'visual_confirmation_missing' END, CASE WHEN rule_confidence < 0.85 THEN 'low_rule_confidence' END,
      CASE WHEN NOT ({ALLOWED.replace('field_key', 'w.field_key')}) THEN 'code_not_allowed' END) AS reasons
  FROM wanted w LEFT JOIN selected s ON w.doc_id = s.doc_id AND w.field_key = s.field_key)
, statused AS (SELECT *, CASE WHEN code IS NULL THEN 'MISSING' WHEN field_key IN ({_CONFLICT}) AND n_codes > 1 THEN 'CONFLICT' WHEN reasons <> '' THEN 'REVIEW' ELSE 'PASS' END AS decision_status FROM judged)
, decided AS (SELECT doc_id, field_key, decision_status,
    CASE WHEN decision_status IN ('PASS', 'REVIEW') THEN code ELSE 'unknown' END AS code,
    CASE WHEN decision_status IN ('PASS', 'REVIEW') THEN effective_confidence ELSE 0.0 END AS confidence,
    CASE WHEN decision_status IN ('PASS', 'REVIEW') THEN evidence_text END AS evidence_span,
    CASE WHEN decision_status IN ('PASS', 'REVIEW') THEN block_id END AS evidence_block_id,
    CASE decision_status WHEN 'MISSING' THEN 'missing_evidence' WHEN 'CONFLICT' THEN 'conflicting_evidence' ELSE reasons END AS review_reasons FROM statused)
"""
GUARDED = DECIDED + f"""
, checked AS (SELECT d.*, b.text AS block_text, CASE
    WHEN code <> 'unknown' AND NOT ({ALLOWED}) THEN 'INVALID_CODE'
    WHEN code <> 'unknown' AND (evidence_span IS NULL OR evidence_block_id IS NULL) THEN 'MISSING_EVIDENCE_SPAN'
    WHEN code <> 'unknown' AND b.text IS NULL THEN 'EVIDENCE_BLOCK_NOT_FOUND'
    WHEN code <> 'unknown' AND NOT contains(b.text, evidence_span) THEN 'EVIDENCE_SPAN_NOT_FOUND' END AS error,
    CASE decision_status WHEN 'CONFLICT' THEN 'CONFLICT' WHEN 'REVIEW' THEN 'DECISION_REVIEW' END AS review
  FROM decided d LEFT JOIN blocks b ON b.doc_id = d.doc_id AND b.block_id = d.evidence_block_id)
, finals AS (SELECT *, (code <> 'unknown' AND error IS NULL AND review IS NULL AND confidence >= 0.85) AS auto FROM checked)
, guarded AS (SELECT doc_id, field_key, CASE WHEN error IS NOT NULL THEN 'unknown' ELSE code END AS code,
    CASE WHEN error IS NOT NULL THEN least(confidence, 0.3) ELSE confidence END AS confidence, coalesce(error, review) AS error_code,
    CASE WHEN error IS NOT NULL THEN 'critical' WHEN NOT auto THEN 'high' ELSE 'low' END AS risk_level, auto AS auto_accepted, NOT auto AS review_required,
    CASE WHEN error IS NOT NULL THEN 'rejected' WHEN auto THEN 'accepted' ELSE 'needs_review' END AS validation_state FROM finals)
"""


def block_scan(spark, sf):
    return _blocks(spark, sf).select("doc_id", "reading_order", "block_id", F.length("text").alias("n_chars"), text.token_estimate(F.col("text")).alias("n_tokens"), "confidence", "block_type")


def section_forward_fill(spark, sf):
    """A heading-like block opens a section that later blocks of the document carry on."""
    blocks = _blocks(spark, sf)
    own = F.when(F.col("text").rlike(SECTION), F.lower(F.regexp_extract("text", SECTION, 0)))
    order = Window.partitionBy("doc_id").orderBy("reading_order").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select("doc_id", "reading_order", "block_id", F.coalesce(F.last(own, True).over(order), F.lit("unknown")).alias("section_label"))


def redact_text(spark, sf):
    docs = texts(spark, sf, "documents")
    keys = text.blocking_findings(F.col("text"))
    return docs.select("doc_id", F.md5(text.redacted(F.col("text"))).alias("redacted_md5"), F.array_join(keys, ",").alias("findings"), F.size(keys).alias("risk_score"), F.array_join(text.blocking_findings(F.col("text"), blocking_only=True), ",").alias("blocking"), (F.size(text.blocking_findings(F.col("text"), blocking_only=True)) == 0).alias("online_allowed"))


def secret_mask(spark, sf):
    """Secrets masked in every whole text; the stored message is cut at the ledger's length."""
    return texts(spark, sf, "documents").select("doc_id", text.masked_secrets(F.col("text"), 2000).alias("masked"))


def rule_evidence(spark, sf):
    return _candidates(spark, sf).select("doc_id", "field_key", "rule_no", "reading_order", "match_no", "block_id", "evidence_text", "code", "rule_confidence")


def rule_first_match(spark, sf):
    return evidence.first_match(_candidates(spark, sf))


def term_code_map(spark, sf):
    return evidence.term_codes(_blocks(spark, sf), TERMS)


def candidate_dedup(spark, sf):
    return evidence.dedup_keep_max(_candidates(spark, sf)).select("doc_id", "field_key", "block_id", "evidence_text", "code", "rule_confidence", "match_no", "n_merged")


def select_by_priority(spark, sf):
    return evidence.select_by_priority(_candidates(spark, sf), POLICIES)


def _decisions(spark, sf):
    return evidence.adjudicate(table(spark, sf, "documents"), _candidates(spark, sf), POLICIES)


def adjudicate(spark, sf):
    return _decisions(spark, sf)


def _guarded(spark, sf):
    return evidence.validate_guardrails(_decisions(spark, sf), _blocks(spark, sf), POLICIES)


def validate_guardrails(spark, sf):
    return _guarded(spark, sf)


def decision_summary(spark, sf):
    """Flagship: adjudicated and guarded fields rolled up."""
    g = _guarded(spark, sf)
    return g.groupBy("field_key", "validation_state").agg(
        F.count("*").alias("n"), F.sum(F.col("auto_accepted").cast("long")).alias("n_auto"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count("error_code").alias("n_errors")
    )


def rule_preaccept_overlay(spark, sf):
    """Candidates at 0.95 and more bypass the provider; the term provider answers the others."""
    blocks = _blocks(spark, sf)
    sure = evidence.first_match(evidence.rule_evidence(blocks, [r for r in RULES if r.confidence >= 0.95])).select("doc_id", "field_key", F.lower("evidence_text").alias("code"))
    terms = evidence.term_codes(blocks, TERMS).select("doc_id", "field_key", "code")
    wanted = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit("token"), F.lit("licence"), F.lit("contact"))).alias("field_key"))
    return evidence.overlay_complete(wanted, sure, terms)


def evidence_bm25(spark, sf):
    return evidence.bm25(_blocks(spark, sf), QUERY_TERMS)


PACK_BUDGET, PACK_ITEMS = 200, 6


def evidence_packs(spark, sf):
    """Scored blocks with their neighbours, cut to the budget, distinct by content, best six a field."""
    blocks = _blocks(spark, sf)
    order = Window.partitionBy("doc_id").orderBy("reading_order")
    context = F.concat_ws("\n", F.lag("text").over(order), F.col("text"), F.lead("text").over(order))
    terms = {"licence": ["license", "licence", "free"], "contact": ["@", "phone", "http", "mail"]}
    lists = F.array(*[F.struct(F.lit(k).alias("field_key"), F.array(*map(F.lit, v)).alias("terms")) for k, v in terms.items()])
    scored = (
        blocks.withColumn("context", context)
        .select("doc_id", "reading_order", "source", "text", "context", F.explode(lists).alias("f"))
        .withColumn("hits", F.size(F.filter("f.terms", lambda t: F.contains(F.lower(F.col("text")), t))))
        .withColumn("score", F.col("hits") + F.when(F.col("source").isin("src0", "src1"), 2).otherwise(0))
        .where("hits > 0")
        .withColumn("excerpt", text.truncated(F.col("context"), PACK_BUDGET))
        .withColumn("pack_hash", F.left(F.sha2(F.concat(F.col("f.field_key"), F.lit(":"), F.regexp_replace("excerpt", r"\s+", "")), 256), F.lit(20)))
    )
    same = Window.partitionBy("doc_id", "f.field_key", "pack_hash").orderBy(F.desc("score"), F.desc("reading_order"))
    best = Window.partitionBy("doc_id", "f.field_key").orderBy(F.desc("score"), F.desc("reading_order"))
    return (
        scored.withColumn("copy", F.row_number().over(same))
        .where("copy = 1")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= PACK_ITEMS)
        .select("doc_id", F.col("f.field_key").alias("field_key"), "rank", "score", "reading_order", "pack_hash")
    )


def page_quality(spark, sf):
    """Per document and page of twenty blocks: characters, confidence and its band, first block's kind."""
    blocks = _blocks(spark, sf).withColumn("page_no", F.floor((F.col("reading_order") - 1) / 20) + 1).withColumn("c", F.when(F.length("text") < 40, 0.7).otherwise(0.98))
    return blocks.groupBy("doc_id", "page_no").agg(
        F.sum(F.length("text")).alias("char_count"),
        F.bround(F.avg("c"), 4).alias("avg_confidence"),
        F.count_if(F.col("c") < 0.75).alias("n_low"),
        F.min_by("block_id", "reading_order").alias("first_block"),
        bands.confidence_band3(F.avg("c")).alias("band"),
    )


def confidence_histogram(spark, sf):
    blocks = _blocks(spark, sf).withColumn("c", F.least(F.lit(1.0), F.length("text") / 400))
    bins = [F.count_if((F.col("c") >= lo) & (F.col("c") < hi)).alias(f"bin{i}") for i, (lo, hi) in enumerate([(0, 0.5), (0.5, 0.75), (0.75, 0.9), (0.9, 0.95), (0.95, 2)])]
    return blocks.groupBy("source", bands.confidence_band5(F.col("c")).alias("band"), bands.confidence_gate(F.col("c")).alias("gate")).agg(*bins, F.count("*").alias("n"))


def section_rollup(spark, sf):
    blocks = _blocks(spark, sf)
    return blocks.groupBy("source").agg(
        F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_blocks"), F.min(F.struct("doc_id", "reading_order"))["doc_id"].alias("first_doc")
    )


def markdown_block_scan(spark, sf):
    return markdown_blocks(texts(spark, sf, "documents")).select("doc_id", "line_no", F.md5("text").alias("text_md5"), "block_type", "n_cells")


def duplicate_text(spark, sf):
    """Signatures that occur more than once; counts combine before the shuffle."""
    docs = texts(spark, sf, "documents").withColumn("signature", F.md5(text.signature(F.col("text")))).where(F.length(text.signature(F.col("text"))) >= 4)
    return docs.groupBy("signature").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def export_pivot(spark, sf):
    """One row a document in template order; the gate decides value or unknown, with its reason."""
    g = _guarded(spark, sf)
    reason = F.when(F.col("review_required"), "review_required").when(F.coalesce(F.col("code"), F.lit("unknown")) == "unknown", "unknown_or_missing_value").otherwise("pass_decision")
    value = F.when(reason == "pass_decision", F.col("code")).otherwise("unknown")
    keys = [p.field_key for p in POLICIES]
    return g.withColumn("reason", reason).withColumn("value", value).groupBy("doc_id").agg(
        *[F.max(F.when(F.col("field_key") == k, F.col("value"))).alias(k) for k in keys], F.count_if(F.col("reason") == "pass_decision").alias("n_exported"), F.count_if(F.col("reason") == "review_required").alias("n_review")
    )


def safe_derivation(spark, sf):
    """A derived code is kept only if all matching rules of the document give exactly one."""
    hits = evidence.term_codes(_blocks(spark, sf), (("kind", "code", "token", 0.9), ("kind", "code", "password", 0.9), ("kind", "legal", "license", 0.9), ("kind", "legal", "copyright", 0.8)))
    single = hits.where("n_codes = 1")
    last = _blocks(spark, sf).groupBy("doc_id").agg(F.max("reading_order").alias("last"))
    return single.join(last, "doc_id").select("doc_id", "code", (F.col("last") + 1).alias("reading_order"), F.concat(F.lit("kind: "), F.col("code")).alias("safe_text"))


def run_quality(spark, sf):
    """Field, page and block counts of a document with its coverage."""
    g = _guarded(spark, sf).groupBy("doc_id").agg(
        F.count_if("auto_accepted").alias("accepted"), F.count_if("review_required").alias("review"), F.count_if(F.col("code") == "unknown").alias("unknown"), F.count("*").alias("fields")
    )
    b = _blocks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("blocks"))
    return g.join(b, "doc_id", "left").select("*", F.round(bands.ratio(F.col("accepted"), F.col("fields") - F.col("unknown"), 1.0), 6).alias("evidence_coverage"))


FN = {f.__name__: f for f in (block_scan, section_forward_fill, redact_text, secret_mask, rule_evidence, rule_first_match, term_code_map, candidate_dedup, select_by_priority, adjudicate, validate_guardrails, decision_summary, rule_preaccept_overlay, evidence_bm25, evidence_packs, page_quality, confidence_histogram, section_rollup, markdown_block_scan, duplicate_text, export_pivot, safe_derivation, run_quality)}


def _mask_sql(column: str) -> str:
    for p, r in text.SECRET_PATTERNS:
        column = f"regexp_replace({column}, '{p}', '{r.replace('${1}', chr(92) + '1')}', 'g')"
    return column


def _redact_sql(column: str) -> str:
    for _, p, r, _ in text.PHI_PATTERNS:
        column = f"regexp_replace({column}, '{p}', '{r}', 'g')"
    return column


def _terms_sql(terms) -> str:
    rows = ", ".join(f"('{f}', '{c}', '{t}', CAST({x} AS DOUBLE), {i})" for i, (f, c, t, x) in enumerate(terms))
    return f"""hits AS (SELECT b.doc_id, b.block_id, b.reading_order, t.* FROM blocks b JOIN (VALUES {rows}) t(field_key, code, term, term_confidence, term_no) ON contains(lower(b.text), t.term)),
    coded AS (SELECT doc_id, field_key, code, term, block_id, n_codes, n_hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_key ORDER BY term_confidence DESC, length(term) DESC, reading_order, term_no) AS rn FROM hits)
      JOIN (SELECT doc_id, field_key, count(DISTINCT code) AS n_codes, count(*) AS n_hits FROM hits GROUP BY ALL) USING (doc_id, field_key) WHERE rn = 1)"""


_findings = lambda only: "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p, _, b in text.PHI_PATTERNS if b or not only) + ")"
_size = lambda x: f"CAST(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ',')) END AS INTEGER)"
_bm_tf = ", ".join(f"len(list_filter(w, lambda t: t = '{q}')) AS tf{i}" for i, q in enumerate(QUERY_TERMS))
_bm_idf = ", ".join(f"ln((n - sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) OVER p + 0.5) / (sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) OVER p + 0.5)) AS raw{i}" for i in range(len(QUERY_TERMS)))
_bm_score = " + ".join(f"(CASE WHEN raw{i} <= 0 THEN 1e-6 ELSE raw{i} END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / average))" for i in range(len(QUERY_TERMS)))
_bm_hits = " + ".join(f"(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END)" for i in range(len(QUERY_TERMS)))

SQL = {
    "block_scan": f"WITH {PARTS} SELECT doc_id, reading_order, block_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(greatest(1, ceil(length(text) / 2.0)) AS BIGINT) AS n_tokens, CAST(0.98 AS DOUBLE) AS confidence, 'text' AS block_type FROM blocks",
    "section_forward_fill": f"WITH {PARTS}, s AS (SELECT *, CASE WHEN regexp_matches(text, '{SECTION}') THEN lower(regexp_extract(text, '{SECTION}', 0)) END AS own FROM blocks) SELECT doc_id, reading_order, block_id, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS section_label FROM s",
    "redact_text": f"SELECT doc_id, md5({_redact_sql('text')}) AS redacted_md5, {_findings(False)} AS findings, {_size(_findings(False))} AS risk_score, {_findings(True)} AS blocking, {_findings(True)} = '' AS online_allowed FROM documents",
    "secret_mask": f"SELECT doc_id, left({_mask_sql('text')}, 2000) AS masked FROM documents",
    "rule_evidence": f"WITH {CANDIDATES} SELECT doc_id, field_key, rule_no, reading_order, match_no, block_id, evidence_text, code, rule_confidence FROM candidates",
    "rule_first_match": f"WITH {CANDIDATES} SELECT doc_id, field_key, evidence_text, block_id, rule_no, reading_order, n_candidates FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_key ORDER BY rule_no, reading_order, match_no) AS rn, count(*) OVER (PARTITION BY doc_id, field_key) AS n_candidates FROM candidates) WHERE rn = 1",
    "term_code_map": f"WITH {PARTS}, {_terms_sql(TERMS)} SELECT * FROM coded",
    "candidate_dedup": f"WITH {CANDIDATES} SELECT doc_id, field_key, block_id, evidence_text, code, rule_confidence, match_no, n_merged FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_key, block_id, evidence_text, code ORDER BY rule_confidence DESC, rule_no, match_no) AS rn, count(*) OVER (PARTITION BY doc_id, field_key, block_id, evidence_text, code) AS n_merged FROM candidates) WHERE rn = 1",
    "select_by_priority": f"WITH {RANKED} SELECT * FROM selected",
    "adjudicate": f"WITH {DECIDED} SELECT * FROM decided",
    "validate_guardrails": f"WITH {GUARDED} SELECT * FROM guarded",
    "decision_summary": f"WITH {GUARDED} SELECT field_key, validation_state, count(*) AS n, CAST(sum(CAST(auto_accepted AS INTEGER)) AS BIGINT) AS n_auto, round(avg(confidence), 6) AS avg_confidence, count(error_code) AS n_errors FROM guarded GROUP BY ALL",
    "rule_preaccept_overlay": f"WITH {CANDIDATES}, {_terms_sql(TERMS)}, sure AS (SELECT doc_id, field_key, min_by(code, reading_order * 100000 + match_no) AS code FROM candidates WHERE rule_confidence >= 0.95 GROUP BY ALL), wanted AS (SELECT doc_id, unnest(['token', 'licence', 'contact']) AS field_key FROM documents) SELECT w.doc_id, w.field_key, coalesce(a.code, o.code, 'unknown') AS code, CASE WHEN a.code IS NOT NULL THEN 'rule' WHEN o.code IS NOT NULL THEN 'provider' ELSE 'missing' END AS origin, CASE WHEN coalesce(a.code, o.code) IS NULL THEN 'MISSING_PROVIDER_RESULT' END AS error_code FROM wanted w LEFT JOIN sure a USING (doc_id, field_key) LEFT JOIN coded o USING (doc_id, field_key)",
    "evidence_bm25": f"WITH {PARTS}, w AS (SELECT doc_id, block_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM blocks), c AS (SELECT doc_id, block_id, len(w) AS size, {_bm_tf} FROM w), s AS (SELECT *, count(*) OVER p AS n, avg(size) OVER p AS average FROM c WINDOW p AS (PARTITION BY doc_id)), r AS (SELECT *, {_bm_idf} FROM s WINDOW p AS (PARTITION BY doc_id)) SELECT doc_id, block_id, CAST(size AS INTEGER) AS size, CAST({_bm_hits} AS INTEGER) AS n_terms, round({_bm_score}, 6) AS bm25 FROM r WHERE {_bm_hits} > 0",
    "evidence_packs": rf"WITH {PARTS}, c AS (SELECT *, concat_ws(chr(10), lag(text) OVER w, text, lead(text) OVER w) AS context FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY reading_order)), f AS (SELECT c.*, t.field_key, len(list_filter(t.terms, lambda x: contains(lower(c.text), x))) AS hits FROM c, (VALUES ('licence', ['license', 'licence', 'free']), ('contact', ['@', 'phone', 'http', 'mail'])) t(field_key, terms)), s AS (SELECT *, hits + CASE WHEN source IN ('src0', 'src1') THEN 2 ELSE 0 END AS score, CASE WHEN length(context) > {PACK_BUDGET} THEN left(context, {PACK_BUDGET} - 3) || '...' ELSE context END AS excerpt FROM f WHERE hits > 0), h AS (SELECT *, left(sha256(field_key || ':' || regexp_replace(excerpt, '\s+', '', 'g')), 20) AS pack_hash FROM s), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_key, pack_hash ORDER BY score DESC, reading_order DESC) AS copy FROM h) WHERE copy = 1), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_key ORDER BY score DESC, reading_order DESC) AS rank FROM d) SELECT doc_id, field_key, CAST(rank AS INTEGER) AS rank, CAST(score AS INTEGER) AS score, reading_order, pack_hash FROM k WHERE rank <= {PACK_ITEMS}",
    "page_quality": f"WITH {PARTS}, b AS (SELECT *, CAST(floor((reading_order - 1) / 20.0) + 1 AS BIGINT) AS page_no, CASE WHEN length(text) < 40 THEN 0.7::DOUBLE ELSE 0.98::DOUBLE END AS c FROM blocks) SELECT doc_id, page_no, CAST(sum(length(text)) AS BIGINT) AS char_count, round_even(avg(c), 4) AS avg_confidence, count(*) FILTER (c < 0.75) AS n_low, min_by(block_id, reading_order) AS first_block, CASE WHEN avg(c) >= 0.9 THEN 'high' WHEN avg(c) >= 0.75 THEN 'medium' ELSE 'low' END AS band FROM b GROUP BY ALL",
    "confidence_histogram": f"WITH {PARTS}, b AS (SELECT *, least(1.0::DOUBLE, length(text) / 400.0::DOUBLE) AS c FROM blocks) SELECT source, CASE WHEN c >= 0.95 THEN 'excellent' WHEN c >= 0.9 THEN 'good' WHEN c >= 0.75 THEN 'fair' WHEN c >= 0.5 THEN 'poor' ELSE 'bad' END AS band, CASE WHEN c >= 0.9 THEN 'accept' WHEN c >= 0.5 THEN 'review' ELSE 'reject' END AS gate, count(*) FILTER (c < 0.5) AS bin0, count(*) FILTER (c >= 0.5 AND c < 0.75) AS bin1, count(*) FILTER (c >= 0.75 AND c < 0.9) AS bin2, count(*) FILTER (c >= 0.9 AND c < 0.95) AS bin3, count(*) FILTER (c >= 0.95) AS bin4, count(*) AS n FROM b GROUP BY ALL",
    "section_rollup": f"WITH {PARTS} SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs, count(DISTINCT doc_id) AS n_docs, count(*) AS n_blocks, min(doc_id) AS first_doc FROM blocks GROUP BY ALL",
    "markdown_block_scan": r"WITH l AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) - 1 AS line_no FROM documents), r AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS raw FROM l), c AS (SELECT *, list_filter(list_transform(string_split(raw, '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS cells FROM r WHERE NOT regexp_matches(raw, '^[\s|:-]*$')), t AS (SELECT doc_id, line_no, CASE WHEN contains(raw, '|') THEN array_to_string(cells, ' | ') ELSE regexp_replace(regexp_replace(raw, '^(#{1,6}\s+|[-*+]\s+|[0-9]+[.)]\s+)', ''), '^\s+|\s+$', '', 'g') END AS text, CASE WHEN regexp_matches(raw, '^#{1,6}\s+') THEN 'title' WHEN contains(raw, '|') THEN 'table' ELSE 'paragraph' END AS block_type, CAST(len(cells) AS INTEGER) AS n_cells FROM c) SELECT doc_id, line_no, md5(text) AS text_md5, block_type, n_cells FROM t WHERE text <> ''",
    "duplicate_text": r"SELECT md5(s) AS signature, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS s FROM documents) WHERE length(s) >= 4 GROUP BY 1 HAVING count(*) > 1",
    "export_pivot": f"WITH {GUARDED}, r AS (SELECT *, CASE WHEN review_required THEN 'review_required' WHEN coalesce(code, 'unknown') = 'unknown' THEN 'unknown_or_missing_value' ELSE 'pass_decision' END AS reason FROM guarded), v AS (SELECT *, CASE WHEN reason = 'pass_decision' THEN code ELSE 'unknown' END AS value FROM r) SELECT doc_id, " + ", ".join(f"max(CASE WHEN field_key = '{p.field_key}' THEN value END) AS {p.field_key}" for p in POLICIES) + ", count(*) FILTER (reason = 'pass_decision') AS n_exported, count(*) FILTER (reason = 'review_required') AS n_review FROM v GROUP BY doc_id",
    "safe_derivation": f"WITH {PARTS}, {_terms_sql((('kind', 'code', 'token', 0.9), ('kind', 'code', 'password', 0.9), ('kind', 'legal', 'license', 0.9), ('kind', 'legal', 'copyright', 0.8)))} SELECT c.doc_id, c.code, CAST(l.last + 1 AS INTEGER) AS reading_order, 'kind: ' || c.code AS safe_text FROM coded c JOIN (SELECT doc_id, max(reading_order) AS last FROM blocks GROUP BY 1) l USING (doc_id) WHERE n_codes = 1",
    "run_quality": f"WITH {GUARDED}, g AS (SELECT doc_id, count(*) FILTER (auto_accepted) AS accepted, count(*) FILTER (review_required) AS review, count(*) FILTER (code = 'unknown') AS unknown, count(*) AS fields FROM guarded GROUP BY 1), b AS (SELECT doc_id, count(*) AS blocks FROM blocks GROUP BY 1) SELECT g.*, b.blocks, round(CASE WHEN fields - unknown = 0 THEN 1.0 ELSE accepted::DOUBLE / (fields - unknown) END, 6) AS evidence_coverage FROM g LEFT JOIN b USING (doc_id)",
}
