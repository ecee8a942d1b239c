"""Evidence collection on literal rows, and the untested folds against plain Python."""

import difflib
import unicodedata

from pyspark.sql import functions as F

from blockquery.operators import collect, ocr
from blockquery.operators.collect import HistoryField, Language
from blockquery.plans import collection

CHINESE = Language(
    negations=("否认", "无", "未见"),
    doubts=("?", "？", "待排", "疑似"),
    ends=("。", "；", ";", "\n"),
    cleared=(r"(?:既往史|个人史)[：:]?\s*(?:无特殊|未见异常)", r"(?:余|其他)[^。；;\n]{0,12}(?:无特殊|无异常)"),
)
FIELDS = (
    HistoryField("hypertension", ("高血压",), ("既往史",), ("家族史",), implicit_negative=True),
    HistoryField("diabetes", ("糖尿病",), ("既往史",), ("家族史",)),
)
CASES = [
    ("既往史", "既往史：否认高血压病、糖尿病。"),
    ("既往史", "糖尿病史15年。高血压史5年，未诉不适。"),
    ("既往史", "疑似糖尿病"),
    ("家族史", "父亲有高血压"),
    ("个人史", "个人史：无特殊"),
    ("既往史", "既往史：无特殊"),
    ("既往史", None),
    (None, "患高血压"),
    ("既往史", "无不适。高血压；无糖尿病"),
]


def test_history_evidence_of_literal_cases(spark):
    rows = [(1, i, s, t, "line") for i, (s, t) in enumerate(CASES)]
    blocks = spark.createDataFrame(rows, "doc_id long, reading_order int, section string, text string, block_type string")
    got = {(r.reading_order, r.field_key): (r.code, r.source_type, r.evidence_text) for r in collect.collect_evidence(blocks, FIELDS, CHINESE).collect()}
    assert {k: v[:2] for k, v in got.items()} == {
        (0, "hypertension"): ("0", "line"),
        (0, "diabetes"): ("0", "line"),
        (1, "hypertension"): ("1", "line"),
        (1, "diabetes"): ("1", "line"),
        (5, "hypertension"): ("0", "implicit_negative"),
        (7, "hypertension"): ("1", "line"),
        (8, "hypertension"): ("1", "line"),
        (8, "diabetes"): ("0", "line"),
    }
    assert got[8, "hypertension"][2] == "高血压" and got[1, "diabetes"][2] == "糖尿病史15年"
    assert collect.collect_evidence(blocks.limit(0), FIELDS, CHINESE).count() == 0


def _plain_positive(text, term, language):
    at = text.find(term)
    while at >= 0:
        left = text[max(0, at - 12) : at]
        left = left[max(left.rfind(e) for e in language.ends) + 1 :]
        right = text[at + len(term) : at + len(term) + 24]
        right = next((right[: right.find(e)] for e in language.ends if e in right), right)
        if not any(n in left for n in language.negations):
            return (left + term + right).strip(collect.TRIMMED)
        at = text.find(term, at + len(term))
    return None


def test_positive_spans_equal_plain_python(spark):
    language = Language(("not", "no"), ("?",), (".", ";", "\n"), ("x",))
    texts = ["aa", "aa aa not aa", "not aa. aa; bb.cc", "no\naa aa", "aaaa", "z" * 30 + "aa" + "y;" * 20, "no aa", ".aa", "not. a\naa b;c.d"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("span", collect.positive_span(F.col("text"), "aa", language))
    assert {r.text: r.span for r in frame.collect()} == {t: _plain_positive(t, "aa", language) for t in texts}


def test_selection_rules(spark):
    row = spark.range(1).select(
        collect.model_chain(F.lit("a"), F.array(F.lit("b"), F.lit("a"), F.lit("x")), ("a", "b")).alias("chain"),
        collect.longest_label(F.lit("therefore"), ("the", "there")).alias("label"),
        collect.query_terms(F.lit("One, one two-three 4 five")).alias("terms"),
        collect.first_rule(F.lit("b"), (("k1", ("a",)), ("k2", ("b", "a"))), "other").alias("kind"),
        *[collect.usable_text(F.lit(t), ("canonical",)).alias(f"u{i}") for i, t in enumerate((" 第3页 ", "Candidate_ID: 4", "  ", "plain", "第一"))],
        collect.usable_text(F.lit(None).cast("string")).alias("u5"),
    ).first()
    assert row.chain == ["a", "b"] and row.label == "there" and row.terms == ["one", "two", "three", "five"] and row.kind == "k2"
    assert [row[f"u{i}"] for i in range(6)] == [False, False, False, True, True, False]


def test_every_collection_query_has_sql():
    assert collection.FN.keys() == collection.SQL.keys()


def test_text_similarity_equals_the_matcher(spark):
    from blockquery.functions import similarity

    pairs = [("abcd", "bcde"), ("", ""), ("Same!", "sa me"), ("recognised text", "recognized text"), ("abc", "xyz"), ("ＡＢ", "ab"), ("", "a"), (None, "")]
    frame = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.sequence_ratio(F.col("a"), F.col("b")).alias("s"))
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "").casefold() if c.isalnum())
    assert all(abs(r.s - difflib.SequenceMatcher(None, plain(r.a), plain(r.b)).ratio()) < 1e-6 for r in frame.collect())
    words = spark.createDataFrame([("a b c", "a x c d"), ("", "one two"), (None, None)], "a string, b string")
    assert [r[0] for r in words.select(similarity.word_distance("a", "b")).collect()] == [2, 2, 0]


def test_greedy_folds_equal_plain_python(spark):
    """Clusters by first match, and one-to-one matches, on boxes of one page."""
    import random

    draw = random.Random(6)
    boxes = [(k, 1, [float(x), float(y), float(x + 20), float(y + 10)]) for k, (x, y) in enumerate((draw.randrange(60), draw.randrange(30)) for _ in range(40))]

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(w, 0) * max(h, 0)
        return inter / (400 - inter)

    groups = []
    for k, _, box in boxes:
        own = next((g for g in groups if any(iou(box, boxes[m][2]) >= 0.5 for m in g)), None)
        own.append(k) if own is not None else groups.append([k])
    frame = spark.createDataFrame(boxes, "box_id long, page int, bbox array<double>")
    rows = ocr.first_match_clusters(frame).toPandas()
    label = next(c for c in rows.columns if c not in ("box_id", "page", "bbox"))
    assert sorted(sorted(g) for g in rows.groupby(label)["box_id"].apply(list)) == sorted(groups)
