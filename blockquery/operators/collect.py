"""Local evidence collection: history terms and section statements to candidate rows.

A field's terms, negations and sections are bounded configuration, so they are
literals of the plan: a block is scanned once and its candidates are exploded,
without a join or a shuffle. Null texts and empty term lists give no candidate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIMMED = " ,.;\n\t"


@dataclass(frozen=True)
class HistoryField:
    """One yes/no field: its terms, and which sections may or may not speak of it."""

    field_key: str
    terms: tuple[str, ...]
    source_sections: tuple[str, ...] = ()
    excluded_sections: tuple[str, ...] = ()
    implicit_negative: bool = False


@dataclass(frozen=True)
class Language:
    """Words that negate or doubt, the ends of a clause in order of precedence, and statements that clear a section."""

    negations: tuple[str, ...]
    doubts: tuple[str, ...]
    ends: tuple[str, ...]
    cleared: tuple[str, ...]


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


def _ends_class(ends: tuple[str, ...]) -> str:
    return "".join(re.escape(e) for e in ends)


def found(text: Column, pattern: str) -> Column:
    """The first match, or null."""
    match = F.regexp_extract(text, pattern, 0)
    return F.when(match != "", match)


def negative_span(text: Column, term: str, language: Language) -> Column:
    """A negation, at most 50 characters of its clause, the term and up to 20 more; null if there is none."""
    inside = f"[^{_ends_class(language.ends)}]"
    return F.btrim(found(text, f"(?:{_any_of(language.negations)}){inside}{{0,50}}{re.escape(term)}{inside}{{0,20}}"), F.lit(TRIMMED))


def positive_span(text: Column, term: str, language: Language) -> Column:
    """The first occurrence whose 12 characters before it, within its clause, hold no negation; 24 more follow."""
    parts = F.split(text, re.escape(term))

    def span(k: Column) -> Column:
        start = F.length(F.array_join(F.slice(parts, 1, k), term))
        left = F.regexp_replace(F.right(F.left(text, start), F.lit(12)), f"(?s)^.*[{_ends_class(language.ends)}]", "")
        right = F.substring(text, start + len(term) + 1, F.lit(24))
        # The first kind of end that occurs cuts, wherever it stands.
        cut = reduce(lambda rest, e: F.when(F.instr(right, e) > 0, F.left(right, F.instr(right, e) - 1)).otherwise(rest), reversed(language.ends), right)
        return F.when(~left.rlike(_any_of(language.negations)), F.btrim(F.concat(left, F.lit(term), cut), F.lit(TRIMMED)))

    places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.try_element_at(F.array_compact(F.transform(places, span)), F.lit(1))


def uncertain(span: Column, language: Language) -> Column:
    return span.rlike(_any_of(language.doubts))


def section_cleared(text: Column, language: Language) -> Column:
    """The first statement, in order of the patterns, that a section holds nothing of note."""
    return F.coalesce(*(found(text, p) for p in language.cleared))


def _row(field: HistoryField, value: str, code: str, span: Column, source: Column, confidence: float, seen: Column) -> Column:
    return F.struct(
        F.lit(field.field_key).alias("field_key"), F.lit(value).alias("raw_value"), F.lit(code).alias("code"), span.alias("evidence_text"),
        source.alias("source_type"), F.lit(confidence).alias("confidence"), seen.alias("label_seen"),
    )


def collect_evidence(blocks: DataFrame, fields: tuple[HistoryField, ...], language: Language) -> DataFrame:
    """Candidates of every block: per term a negative, else a certain positive one; and cleared sections."""
    text, section, own = F.col("text"), F.col("section"), F.coalesce(F.col("block_type"), F.lit("text"))
    rows = []
    for field in fields:
        open_ = ~F.coalesce(section.isin(*field.excluded_sections), F.lit(False)) if field.excluded_sections else F.lit(True)
        for term in field.terms:
            seen, no, yes = F.lit(term), negative_span(text, term, language), positive_span(text, term, language)
            sure = F.when(yes.isNotNull() & ~uncertain(yes, language), _row(field, "present", "1", yes, own, 0.88, seen))
            rows.append(F.when(open_ & text.contains(term), F.when(no.isNotNull(), _row(field, "absent", "0", no, own, 0.92, seen)).otherwise(sure)))
        if field.implicit_negative:
            span = section_cleared(text, language)
            rows.append(F.when(open_ & section.isin(*field.source_sections) & span.isNotNull(), _row(field, "absent", "0", span, F.lit("implicit_negative"), 0.78, section)))
    return blocks.select("doc_id", "reading_order", F.explode(F.array_compact(F.array(*rows))).alias("c")).select("doc_id", "reading_order", "c.*")


def block_set_score(blocks: DataFrame, key: str) -> DataFrame:
    """What a set of blocks is compared by: characters, then average confidence."""
    return blocks.groupBy(key).agg(F.sum(F.length("text")).alias("n_chars"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def canonical_pick(candidates: DataFrame, key: str) -> DataFrame:
    """One candidate a group: by stage priority, then confidence, then id; combined before the shuffle."""
    order = F.struct("priority", (-F.col("confidence")).alias("c"), F.coalesce("candidate_id", F.lit("")).alias("i"))
    return candidates.groupBy(key).agg(F.min_by("candidate_id", order).alias("candidate_id"), F.count("*").alias("n"))


def position_key(band: float = 48.0) -> Column:
    """Order on a page: bands of the centre's height (half to even), cells before text within a band."""
    b = F.col("bbox")
    row_band = F.bround((b[1] + b[3]) / 2 / band, 0)
    cell = (F.col("block_type") == "cell") & F.col("table_id").isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()
    return F.struct(row_band.alias("band"), F.when(cell, 0).otherwise(1).alias("kind"), F.when(cell, F.col("row")).alias("r"), F.when(cell, F.col("col")).alias("c"), b[0].alias("left"), b[1].alias("top"), F.col("text"))


#: Beginnings of the recogniser's own notes.
INTERNAL_NOTES = ("canonical:", "candidate_id", "candidate_group_id", "merge_flags", "conflict_flags", "layout_region_id", "line_group_id")


def usable_text(text: Column, stages: tuple[str, ...] = (), marker: tuple[str, str] = ("第", "页")) -> Column:
    """Not empty, no note of the recogniser itself and no page marker."""
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    low = F.lower(plain)
    note = reduce(lambda a, p: a | low.startswith(p), (*INTERNAL_NOTES, *(f"{s}:" for s in stages)), low == "canonical_selected")
    return F.coalesce((plain != "") & ~note & ~(plain.startswith(marker[0]) & plain.endswith(marker[1])), F.lit(False))


def first_rule(value: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    """The result of the first rule that lists the value, else the default."""
    return F.coalesce(*(F.when(value.isin(*members), F.lit(kind)) for kind, members in rules), F.lit(default))


def longest_label(text: Column, labels: tuple[str, ...]) -> Column:
    """The longest label that opens the text; equal lengths in the given order."""
    return F.coalesce(*(F.when(text.startswith(x), F.lit(x)) for x in sorted(labels, key=len, reverse=True)))


def query_terms(text: Column, most: int = 12, least_length: int = 2) -> Column:
    """The first distinct terms of a query that can be looked up; the cap is the operator's own."""
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least_length)
    return F.slice(F.array_distinct(terms), 1, most)


def model_chain(primary: Column, fallbacks: Column, known: tuple[str, ...]) -> Column:
    """The primary and its fallbacks in order, each once, unknown ones left out."""
    return F.array_distinct(F.filter(F.concat(F.array(primary), fallbacks), lambda m: m.isin(*known)))
