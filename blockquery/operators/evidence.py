"""Evidence: rules and terms over blocks to candidates, selection, adjudication and guardrails.

Rules travel as literal arrays of the plan (a bounded configuration), so rule
evidence is a projection and an explode of each block: no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    field_key: str
    rule_no: int
    pattern: str
    group: int
    confidence: float


@dataclass(frozen=True)
class Policy:
    field_key: str
    review_conflict: bool
    source_priority: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    visual: bool = False


def rule_evidence(blocks: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every match of every rule: one candidate each, in rule, block and match order (``seq``)."""
    found = F.array(
        *[
            F.struct(
                F.lit(r.field_key).alias("field_key"),
                F.lit(r.rule_no).alias("rule_no"),
                F.lit(r.confidence).alias("rule_confidence"),
                F.regexp_extract_all(F.col("text"), F.lit(r.pattern), F.lit(r.group)).alias("hits"),
            )
            for r in rules
        ]
    )
    hit = blocks.select("*", F.explode(F.filter(found, lambda x: F.size(x["hits"]) > 0)).alias("hit"))
    kept = [c for c in blocks.columns]
    match = hit.select(*kept, "hit.field_key", "hit.rule_no", "hit.rule_confidence", F.posexplode("hit.hits").alias("match_no", "evidence_text"))
    return match.withColumn("code", F.lower("evidence_text")).withColumn("match_no", F.col("match_no") + 1)


def with_effective_confidence(candidates: DataFrame) -> DataFrame:
    """The largest of rule and block confidence counts."""
    return candidates.withColumn("effective_confidence", F.greatest("rule_confidence", "confidence"))


_ORDER = ("rule_no", "reading_order", "match_no")


def first_match(candidates: DataFrame) -> DataFrame:
    """The first candidate of each field in rule-major order."""
    first = F.min_by(F.struct("evidence_text", "block_id", "rule_no", "reading_order"), F.struct(*_ORDER))
    return candidates.groupBy("doc_id", "field_key").agg(first.alias("first"), F.count("*").alias("n_candidates")).select("doc_id", "field_key", "first.*", "n_candidates")


def dedup_keep_max(candidates: DataFrame) -> DataFrame:
    """One candidate a (block, evidence, code): the most confident, the first on ties."""
    keys = ("doc_id", "field_key", "block_id", "evidence_text", "code")
    best = F.max_by(F.struct("rule_confidence", "confidence", "reading_order", "rule_no", "match_no", "source", "lang"), F.struct("rule_confidence", -F.col("rule_no"), -F.col("match_no")))
    return candidates.groupBy(*keys).agg(best.alias("best"), F.count("*").alias("n_merged")).select(*keys, "best.*", "n_merged")


def priority_rank(place: Column, priority: Column) -> Column:
    """Place of the first priority item that is a substring of the joined place; past the end if none, 0 without a list."""
    ranks = F.filter(F.transform(priority, lambda p, i: F.when(F.contains(place, p), i)), lambda i: i.isNotNull())
    return F.when(F.size(priority) == 0, 0).otherwise(F.coalesce(F.try_element_at(ranks, F.lit(1)), F.size(priority)))


def _policy_map(policies: Sequence[Policy], value) -> Column:
    return F.create_map(*[x for p in policies for x in (F.lit(p.field_key), value(p))])


def select_by_priority(candidates: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """The candidate of each field with the best (priority rank, confidence, block confidence, order)."""
    lists = _policy_map(policies, lambda p: F.array(*[F.lit(x) for x in p.source_priority]).cast("array<string>"))
    place = F.concat_ws(" ", "source", "lang")
    ranked = with_effective_confidence(candidates).withColumn("priority_rank", priority_rank(place, lists[F.col("field_key")]))
    order = F.struct("priority_rank", -F.col("effective_confidence"), -F.col("confidence"), *_ORDER)
    chosen = F.min_by(F.struct("evidence_text", "code", "block_id", "priority_rank", "rule_confidence", "effective_confidence"), order)
    return ranked.groupBy("doc_id", "field_key").agg(
        chosen.alias("chosen"),
        F.size(F.collect_set(F.when(F.col("code") != "unknown", F.col("code")))).cast("long").alias("n_codes"),
    ).select("doc_id", "field_key", "chosen.*", "n_codes")


def adjudicate(documents: DataFrame, candidates: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """PASS, REVIEW, MISSING or CONFLICT of every (document, field), with its review reasons."""
    fields = F.explode(F.array(*[F.lit(p.field_key) for p in policies])).alias("field_key")
    wanted = documents.select("doc_id", fields)
    joined = wanted.join(select_by_priority(candidates, policies), ["doc_id", "field_key"], "left")
    conflict = _policy_map(policies, lambda p: F.lit(p.review_conflict))[F.col("field_key")]
    visual = _policy_map(policies, lambda p: F.lit(p.visual))[F.col("field_key")]
    reasons = F.array_compact(
        F.array(
            F.when(visual, "visual_confirmation_missing"),
            F.when(F.col("rule_confidence") < 0.85, "low_rule_confidence"),
            F.when(~allowed_code(F.col("code"), F.col("field_key"), policies), "code_not_allowed"),
        )
    )
    status = F.when(F.col("code").isNull(), "MISSING").when(conflict & (F.col("n_codes") > 1), "CONFLICT").when(F.size(reasons) > 0, "REVIEW").otherwise("PASS")
    said = F.when(status == "MISSING", F.array(F.lit("missing_evidence"))).when(status == "CONFLICT", F.array(F.lit("conflicting_evidence"))).otherwise(reasons)
    known = status.isin("PASS", "REVIEW")
    return joined.select(
        "doc_id",
        "field_key",
        status.alias("decision_status"),
        F.when(known, F.col("code")).otherwise("unknown").alias("code"),
        F.when(known, F.col("effective_confidence")).otherwise(0.0).alias("confidence"),
        F.when(known, F.col("evidence_text")).alias("evidence_span"),
        F.when(known, F.col("block_id")).alias("evidence_block_id"),
        F.array_join(said, ",").alias("review_reasons"),
    )


def allowed_code(code: Column, field: Column, policies: Sequence[Policy]) -> Column:
    """A listed code, or a wildcard: text and duration take anything known, integer takes digits."""
    lists = _policy_map(policies, lambda p: F.array(*[F.lit(x) for x in p.allowed]).cast("array<string>"))[field]
    return (
        F.array_contains(lists, code)
        | ((F.array_contains(lists, F.lit("text")) | F.array_contains(lists, F.lit("duration"))) & (code != "unknown"))
        | (F.array_contains(lists, F.lit("integer")) & code.rlike("^[0-9]+$"))
        | (F.size(lists) == 0)
    )


def validate_guardrails(decisions: DataFrame, blocks: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Ordered guardrails: a failed test downgrades to unknown, a doubt asks for review, the rest is accepted."""
    block = blocks.select("doc_id", F.col("block_id").alias("evidence_block_id"), F.col("text").alias("block_text"), F.col("confidence").alias("block_confidence"))
    joined = decisions.join(block, ["doc_id", "evidence_block_id"], "left")
    known = F.col("code") != "unknown"
    error = (
        F.when(known & ~allowed_code(F.col("code"), F.col("field_key"), policies), "INVALID_CODE")
        .when(known & (F.col("evidence_span").isNull() | F.col("evidence_block_id").isNull()), "MISSING_EVIDENCE_SPAN")
        .when(known & F.col("block_text").isNull(), "EVIDENCE_BLOCK_NOT_FOUND")
        .when(known & ~F.contains(F.col("block_text"), F.col("evidence_span")), "EVIDENCE_SPAN_NOT_FOUND")
    )
    review = F.when(F.col("block_confidence") < 0.75, "LOW_OCR_CONFIDENCE").when(F.col("decision_status") == "CONFLICT", "CONFLICT").when(F.col("decision_status") == "REVIEW", "DECISION_REVIEW")
    failed = error.isNotNull()
    final_known = known & ~failed
    auto = final_known & review.isNull() & (F.col("confidence") >= 0.85)
    return joined.select(
        "doc_id",
        "field_key",
        F.when(failed, "unknown").otherwise(F.col("code")).alias("code"),
        F.when(failed, F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce(error, review).alias("error_code"),
        F.when(failed, "critical").when(~auto, "high").otherwise("low").alias("risk_level"),
        auto.alias("auto_accepted"),
        (~auto).alias("review_required"),
        F.when(failed, "rejected").when(auto, "accepted").otherwise("needs_review").alias("validation_state"),
    )


def overlay_complete(wanted: DataFrame, accepted: DataFrame, offered: DataFrame) -> DataFrame:
    """Upsert by key: accepted rows win over offered ones; a wanted key without either becomes an error row."""
    keys = ["doc_id", "field_key"]
    a = accepted.select(*keys, F.col("code").alias("a_code"))
    o = offered.select(*keys, F.col("code").alias("o_code"))
    return wanted.join(a, keys, "left").join(o, keys, "left").select(
        *keys,
        F.coalesce("a_code", "o_code", F.lit("unknown")).alias("code"),
        F.when(F.col("a_code").isNotNull(), "rule").when(F.col("o_code").isNotNull(), "provider").otherwise("missing").alias("origin"),
        F.when(F.coalesce("a_code", "o_code").isNull(), "MISSING_PROVIDER_RESULT").alias("error_code"),
    )


def term_codes(blocks: DataFrame, terms: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """(field, code) of the best term in a block: (confidence, term length) decide, then the order of terms."""
    rows = F.array(*[F.struct(F.lit(f).alias("field_key"), F.lit(c).alias("code"), F.lit(t).alias("term"), F.lit(x).alias("term_confidence"), F.lit(i).alias("term_no")) for i, (f, c, t, x) in enumerate(terms)])
    hit = blocks.select("doc_id", "block_id", "reading_order", F.explode(F.filter(rows, lambda r: F.contains(F.lower(F.col("text")), r["term"]))).alias("t")).select("doc_id", "block_id", "reading_order", "t.*")
    order = F.struct(-F.col("term_confidence"), -F.length("term"), F.col("reading_order"), F.col("term_no"))
    best = F.min_by(F.struct("code", "term", "block_id"), order)
    return hit.groupBy("doc_id", "field_key").agg(best.alias("best"), F.countDistinct("code").alias("n_codes"), F.count("*").alias("n_hits")).select("doc_id", "field_key", "best.*", "n_codes", "n_hits")


def bm25(blocks: DataFrame, query: Sequence[str]) -> DataFrame:
    """BM25 of each block that holds a query term; the corpus of a block is its own document.

    One aggregation by document: its blocks' term counts are folded in place, so a document's blocks
    meet once and nothing is exploded to terms beyond the query's.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: t != "")

    def frequency(term: str) -> Column:
        return F.size(F.filter(words, lambda t: t == term))

    counted = blocks.select("doc_id", "block_id", F.size(words).alias("size"), *[frequency(q).alias(f"tf{i}") for i, q in enumerate(query)])
    own = Window.partitionBy("doc_id")
    n, average = F.count("*").over(own), F.avg("size").over(own)
    score = F.lit(0.0)
    for i in range(len(query)):
        tf = F.col(f"tf{i}")
        df = F.sum((tf > 0).cast("int")).over(own)
        raw = F.ln((n - df + 0.5) / (df + 0.5))
        idf = F.when(raw <= 0, 1e-6).otherwise(raw)
        score = score + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("size") / average))
    hits = sum((F.col(f"tf{i}") > 0).cast("int") for i in range(len(query)))
    return counted.select("doc_id", "block_id", "size", hits.alias("n_terms"), F.round(score, 6).alias("bm25")).where("n_terms > 0")
