"""Queries of evidence collection and of the small selection rules, each with its SQL written from the rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockquery.operators import collect
from blockquery.operators.collect import HistoryField, Language
from blockquery.plans.sqlparts import PARTS
from blockquery.session import table, texts
from blockquery.sources.blocks import text_blocks

LANGUAGE = Language(negations=("not", "sans", "rewh"), doubts=("?", "orre"), ends=(".", ";", "\n"), cleared=(r"tion[^.;\n]{0,12}that", r"the[^.;\n]{0,6}with"))
FIELDS = (
    HistoryField("license", ("license", "permission"), excluded_sections=("fr",)),
    HistoryField("common", ("with", "from"), ("en",), ("de", "es"), implicit_negative=True),
)
KINDS = (("prose", ("en",)), ("romance", ("fr", "es", "en")))
LABELS = ("the", "then", "there", "that", "un")


def _blocks(spark, sf):
    return text_blocks(texts(spark, sf, "documents"), "lang", "source")


def collect_evidence(spark, sf):
    """History terms and cleared sections of every block, the document's language standing for the section."""
    return collect.collect_evidence(_blocks(spark, sf).withColumn("section", F.col("lang")).withColumn("block_type", F.lit("text")), FIELDS, LANGUAGE)


def _evidence_sql() -> str:
    """Written from the rule: split at the term, look at 12 characters before and 24 after within the clause."""
    no, doubt = "(?:not|sans|rewh)", "\\?|orre"
    trim = " || ".join(("' ,.;'", "chr(10)", "chr(9)"))
    scans = []
    for f in FIELDS:
        closed = ", ".join(f"'{x}'" for x in f.excluded_sections) or "''"
        for term in f.terms:
            scans.append(f"SELECT doc_id, reading_order, text, '{f.field_key}' AS field_key, '{term}' AS term FROM blocks WHERE coalesce(lang, '') NOT IN ({closed}) AND contains(text, '{term}')")
    return rf"""WITH {PARTS}, s AS ({" UNION ALL ".join(scans)}),
negative AS (SELECT *, trim(regexp_extract(text, '{no}[^.;\n]{{0,50}}' || term || '[^.;\n]{{0,20}}'), {trim}) AS no_span FROM s),
split_ AS (SELECT *, string_split(text, term) AS p FROM negative),
places AS (SELECT doc_id, reading_order, field_key, term, text, p, unnest(range(1, len(p))) AS k FROM split_ WHERE no_span = ''),
around AS (SELECT *, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(term) AS INTEGER) AS start FROM places),
sides AS (SELECT *, regexp_replace(right(left(text, start), 12), '^.*[.;\n]', '', 's') AS l, substr(text, start + length(term) + 1, 24) AS r FROM around),
cut AS (SELECT *, CASE WHEN contains(r, '.') THEN left(r, instr(r, '.') - 1) WHEN contains(r, ';') THEN left(r, instr(r, ';') - 1) WHEN contains(r, chr(10)) THEN left(r, instr(r, chr(10)) - 1) ELSE r END AS rest FROM sides),
positive AS (SELECT doc_id, reading_order, field_key, term, min_by(trim(l || term || rest, {trim}), k) AS span FROM cut WHERE NOT regexp_matches(l, 'not|sans|rewh') GROUP BY ALL),
cleared AS (SELECT doc_id, reading_order, coalesce(nullif(regexp_extract(text, 'tion[^.;\n]{{0,12}}that'), ''), nullif(regexp_extract(text, 'the[^.;\n]{{0,6}}with'), '')) AS span FROM blocks WHERE lang = 'en')
SELECT doc_id, reading_order, field_key, 'absent' AS raw_value, '0' AS code, no_span AS evidence_text, 'text' AS source_type, 0.92::DOUBLE AS confidence, term AS label_seen FROM negative WHERE no_span <> ''
UNION ALL SELECT doc_id, reading_order, field_key, 'present', '1', span, 'text', 0.88, term FROM positive WHERE NOT regexp_matches(span, '{doubt}')
UNION ALL SELECT doc_id, reading_order, 'common', 'absent', '0', span, 'implicit_negative', 0.78, 'en' FROM cleared WHERE span IS NOT NULL"""


def block_set_score(spark, sf):
    blocks = _blocks(spark, sf).withColumn("confidence", F.when(F.length("text") < 40, 0.5).otherwise(0.98))
    return collect.block_set_score(blocks, "doc_id")


def canonical_pick(spark, sf):
    """Lines of an order as candidates of one group: by discount band, then quantity, then id."""
    line = table(spark, sf, "lineitem")
    rows = line.select("l_orderkey", F.floor(F.col("l_discount") * 100).cast("long").alias("priority"), F.col("l_quantity").alias("confidence"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("candidate_id"))
    return collect.canonical_pick(rows, "l_orderkey")


def canonical_order(spark, sf):
    """Places of an order's lines on a page of bands."""
    height = F.col("l_quantity") * 12.0
    cell = F.col("l_returnflag") == "R"
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array(F.col("l_discount") * 100, height, F.col("l_discount") * 100 + 50, height + 24).alias("bbox"), F.when(cell, "cell").otherwise("text").alias("block_type"),
        F.when(cell, F.lit("t")).alias("table_id"), F.col("l_linenumber").alias("row"), F.lit(1).alias("col"), F.col("l_linenumber").cast("string").alias("text"),
    )
    return rows.select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(collect.position_key())).alias("place"))


def usable_source_text(spark, sf):
    return _blocks(spark, sf).where(collect.usable_text(F.col("text"), ("the", "ocr"))).select("doc_id", "reading_order")


def document_kinds(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy(collect.first_rule(F.col("lang"), KINDS, "other").alias("kind")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def longest_label(spark, sf):
    return _blocks(spark, sf).select("doc_id", "reading_order", collect.longest_label(F.lower("text"), LABELS).alias("label")).where("label is not null")


def query_terms(spark, sf):
    items = table(spark, sf, "benchmark")
    return items.select("item_id", F.array_join(collect.query_terms(F.regexp_replace("text", "[^\\x20-\\x7e]", " ")), " ").alias("terms"))


def page_union(spark, sf):
    """Distinct page numbers of two sources."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("page")).union(table(spark, sf, "pages").select("page_id")).distinct()


def model_chain(spark, sf):
    """Steps of a user as a chain of fallbacks after the first kind of event."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.min("event_type").alias("first"), F.array_sort(F.collect_set("event_type")).alias("others"))
    return e.select("user_id", F.array_join(collect.model_chain(F.col("first"), F.reverse("others"), ("view", "click", "purchase")), ">").alias("chain"))


FN = {
    f.__name__: f
    for f in (collect_evidence, block_set_score, canonical_pick, canonical_order, usable_source_text, document_kinds, longest_label, query_terms, page_union, model_chain)
}

SQL = {
    "collect_evidence": _evidence_sql(),
    "block_set_score": f"WITH {PARTS} SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS n_chars, round(avg(CASE WHEN length(text) < 40 THEN 0.5 ELSE 0.98 END), 6) AS avg_confidence FROM blocks GROUP BY 1",
    "canonical_pick": """SELECT l_orderkey, arg_min(candidate_id, rank) AS candidate_id, count(*) AS n FROM (
        SELECT l_orderkey, l_partkey || '-' || l_linenumber AS candidate_id,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_discount * 100), l_quantity DESC, l_partkey || '-' || l_linenumber) AS rank FROM lineitem) GROUP BY 1""",
    "canonical_order": """SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even((l_quantity * 12.0 + l_quantity * 12.0 + 24) / 2 / 48.0, 0),
        CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, CASE WHEN l_returnflag = 'R' THEN l_linenumber END, l_discount * 100, l_quantity * 12.0, CAST(l_linenumber AS VARCHAR)) AS INTEGER) AS place FROM lineitem""",
    "usable_source_text": rf"""WITH {PARTS}, t AS (SELECT doc_id, reading_order, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM blocks)
        SELECT doc_id, reading_order FROM t WHERE t <> '' AND lower(t) <> 'canonical_selected' AND NOT (starts_with(t, '第') AND ends_with(t, '页'))
        AND NOT regexp_matches(lower(t), '^(canonical:|candidate_id|candidate_group_id|merge_flags|conflict_flags|layout_region_id|line_group_id|the:|ocr:)')""",
    "document_kinds": "SELECT CASE WHEN lang = 'en' THEN 'prose' WHEN lang IN ('fr', 'es') THEN 'romance' ELSE 'other' END AS kind, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "longest_label": f"""WITH {PARTS} SELECT doc_id, reading_order, CASE WHEN starts_with(lower(text), 'there') THEN 'there' WHEN starts_with(lower(text), 'then') THEN 'then'
        WHEN starts_with(lower(text), 'that') THEN 'that' WHEN starts_with(lower(text), 'the') THEN 'the' WHEN starts_with(lower(text), 'un') THEN 'un' END AS label FROM blocks WHERE label IS NOT NULL""",
    "query_terms": r"""WITH w AS (SELECT item_id, unnest(string_split_regex(lower(regexp_replace(text, '[^\x20-\x7e]', ' ', 'g')), '[^a-z0-9]+')) AS t, generate_subscripts(string_split_regex(lower(regexp_replace(text, '[^\x20-\x7e]', ' ', 'g')), '[^a-z0-9]+'), 1) AS k FROM benchmark),
        d AS (SELECT item_id, t, min(k) AS k FROM w WHERE length(t) >= 2 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k) AS n FROM d)
        SELECT b.item_id, coalesce(string_agg(t, ' ' ORDER BY k), '') AS terms FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND n <= 12 GROUP BY 1""",
    "page_union": "SELECT doc_id AS page FROM documents UNION SELECT page_id FROM pages",
    "model_chain": """WITH k AS (SELECT user_id, min(event_type) AS first, list(DISTINCT event_type) AS kinds FROM events GROUP BY 1),
        c AS (SELECT user_id, list_prepend(first, list_filter(list_reverse_sort(kinds), lambda x: x <> first)) AS chain FROM k)
        SELECT user_id, array_to_string(list_filter(chain, lambda x: x IN ('view', 'click', 'purchase')), '>') AS chain FROM c""",
}
