"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line; an empty one counts) hashes to a wide vector of two parts,
and a document's fingerprint is the sum of its paragraphs' vectors, each lane
modulo 2**16. So the order of paragraphs does not matter, and a paragraph is
inserted or deleted by adding or subtracting its vector.

- ``EXACT`` lanes come from SHAKE-128 of the paragraph: equal sums mean equal
  paragraph multisets but for a negligible chance.
- ``NEAR`` lanes hold, for the paragraph's word trigrams (padded at its start),
  sums of hashed signs. As sums of signs keep inner products, the cosine of two
  fingerprints' NEAR lanes estimates the cosine of their trigram counts, with a
  standard error of about 1/sqrt(NEAR). A lane wraps, harmlessly for equality,
  only beyond 32,767 in magnitude.

Neighbours in id order come from one shuffle by id ranges; each range also gets
the first document of the next one, so no window gathers all rows.

Defined results: null texts are empty texts (one empty paragraph). Without any
word on both sides, likeness is 1 for equal exact lanes and 0 otherwise. Rows
with equal ids are ordered by text. A row with a null id is in no order: its
next document is the empty text. Repeated rows keep their own rows; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from base64 import b64decode, b64encode
from hashlib import sha256, shake_128

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.llm.common import Words, mix64
from blockquery.session import table

EXACT, NEAR = 64, 256
SLICE_CHARS = 400_000
ORDER_RANGES_MIN = 8
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_PAD = np.uint64(0x27D4EB2F165667C5)
_LANE = np.arange(1, NEAR // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)


def exact_lanes(paragraphs: list[str]) -> np.ndarray:
    """Sum of the paragraphs' uniform lanes."""
    if not paragraphs:
        return np.zeros(EXACT, np.uint16)
    wide = b"".join(shake_128(p.encode()).digest(2 * EXACT) for p in paragraphs)
    return np.frombuffer(wide, "<u2").reshape(-1, EXACT).sum(axis=0, dtype=np.uint16)


def near_lanes(segments: list[str]) -> np.ndarray:
    """(segments, NEAR) sums of the signs of each segment's paragraphs."""
    import pyarrow as pa

    words = Words(pa.array(segments, pa.large_string()))
    out = np.zeros((len(segments), NEAR), np.uint16)
    n = len(words.start)
    if not n:
        return out
    h = words.hashes()
    line = np.cumsum(words.data == 0x0A)[words.start] + words.owner() * np.int64(1 << 40)
    one, two = np.full(n, _PAD), np.full(n, _PAD)
    one[1:] = np.where(line[1:] == line[:-1], h[:-1], _PAD)
    two[2:] = np.where(line[2:] == line[:-2], h[:-2], _PAD)
    feature = mix64(h * _K1 + one * _K2 + two * _K3)
    signs = np.unpackbits(mix64(feature[:, None] + _LANE[None, :]).view(np.uint8), axis=1)
    count = np.diff(words.bounds)
    full = np.flatnonzero(count)
    # Eight lanes of one byte are added at once, over runs of at most 255 words of one segment.
    runs = np.concatenate([np.arange(a, b, 255) for a, b in zip(words.bounds[full], words.bounds[full + 1], strict=True)])
    sums = np.add.reduceat(signs.view(np.uint64), runs, axis=0).view(np.uint8).astype(np.int32)
    ones = np.add.reduceat(sums, np.searchsorted(runs, words.bounds[full]), axis=0)
    out[full] = (2 * ones - count[full, None]).astype(np.uint16)
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, EXACT + NEAR) lanes."""
    exact = np.stack([exact_lanes(t.split("\n")) for t in texts]) if texts else np.zeros((0, EXACT), np.uint16)
    return np.concatenate([exact, near_lanes(texts)], axis=1)


def packed(lanes: np.ndarray) -> str:
    return b64encode(lanes.astype("<u2").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(b64decode(fingerprint), "<u2")


def insert(fingerprint: str, paragraph: str) -> str:
    """The fingerprint of the document with one more paragraph."""
    return packed(unpacked(fingerprint) + fingerprints([paragraph])[0])


def delete(fingerprint: str, paragraph: str) -> str:
    """The fingerprint of the document without one of its paragraphs."""
    return packed(unpacked(fingerprint) - fingerprints([paragraph])[0])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1 from two fingerprints' lanes."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT:].astype(np.int16).astype(np.float64) for v in (a, b))
    size = np.sqrt((x @ x) * (y @ y))
    return float(min(max((x @ y) / size, 0.0), 1.0)) if size else 0.0


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_pairs(texts: list[str], followings: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lanes of the texts and, by deletion and insertion of the changed paragraphs, of their edited texts."""
    edited = [edited_text(t, f) for t, f in zip(texts, followings, strict=True)]
    # Paragraphs that end before the edit are common; the rest of either text is deleted or inserted.
    cut = [t.rfind("\n", 0, len(t) - len(t) // 4) + 1 for t in texts]
    n = len(texts)
    parts = [t[:c] for t, c in zip(texts, cut, strict=True)] + [t[c:] for t, c in zip(texts, cut, strict=True)] + [e[c:] for e, c in zip(edited, cut, strict=True)]
    near = near_lanes(parts)
    exact = [exact_lanes(p[:-1].split("\n") if p else []) for p in parts[:n]] + [exact_lanes(p.split("\n")) for p in parts[n:]]
    lanes = np.concatenate([np.stack(exact), near], axis=1) if n else np.zeros((0, EXACT + NEAR), np.uint16)
    own = lanes[:n] + lanes[n : 2 * n]
    return own, own - lanes[n : 2 * n] + lanes[2 * n :], edited


def in_order_ranges(rows: DataFrame) -> DataFrame:
    """Rows with columns ``part`` and ``borrowed``: id ranges, each with the next range's first rows borrowed.

    Only the range bounds and first ids, as many as there are shuffle partitions, reach the driver.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ORDER_RANGES_MIN)
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000).alias("cuts")).first()["cuts"] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    ranged = rows.withColumn("part", part)
    firsts = sorted(tuple(r) for r in ranged.where(F.col("doc_id").isNotNull()).groupBy("part").agg(F.min("doc_id").alias("first")).collect())
    borrows = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    lent = spark.createDataFrame(borrows, "first_id long, to_part int")
    joined = ranged.join(F.broadcast(lent), F.col("doc_id") == F.col("first_id"), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("borrowed"))
    extra = F.struct(F.col("to_part").alias("part"), F.lit(True).alias("borrowed"))
    copies = F.explode(F.when(F.col("to_part").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("copy")
    placed = joined.select("doc_id", "text", copies).select("doc_id", "text", "copy.part", "copy.borrowed")
    return placed.repartition(n, "part").sortWithinPartitions("part", "borrowed", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]

    def finish(pa, group: list[tuple], following: tuple | None):
        """Results of consecutive rows; ``following`` is the row after them."""
        texts = [g[1] for g in group]
        after = [*texts[1:], following[1] if following else ""]
        after = [a if g[0] is not None else "" for a, g in zip(after, group, strict=True)]
        own, edited, edited_texts = fingerprint_pairs(texts, after)
        # Beyond the last row, and for rows without an id, the next fingerprint is not that of the next row here.
        last = fingerprints([after[-1]])
        blank = fingerprints([""])[0]
        nexts = [own[k + 1] if k + 1 < len(group) else last[0] for k in range(len(group))]
        nexts = [x if g[0] is not None else blank for x, g in zip(nexts, group, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([g[0] for g in group], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([sha256(t.encode()).hexdigest() for t in edited_texts]),
                pa.array([packed(x) for x in own]),
                pa.array([packed(x) for x in edited]),
                pa.array([likeness(a, b) for a, b in zip(own, edited, strict=True)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, nexts, strict=True)], pa.float64()),
            ],
            names=names,
        )

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []
        size, part, ended = 0, None, False
        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", "text", "part", "borrowed")]
            for doc_id, text, own_part, borrowed in zip(*columns, strict=True):
                row = (doc_id.as_py(), text.as_py())
                own_part, borrowed = own_part.as_py(), borrowed.as_py()
                if own_part != part:
                    if held:
                        yield finish(pa, held, None)
                    held, size, part, ended = [], 0, own_part, False
                if ended:
                    continue
                if borrowed:
                    if held:
                        yield finish(pa, held, row)
                    held, ended = [], True
                    continue
                if held and size >= SLICE_CHARS:
                    yield finish(pa, held, row)
                    held, size = [], 0
                held.append(row)
                size += len(row[1]) + 200
        if held:
            yield finish(pa, held, None)

    return in_order_ranges(rows).mapInArrow(run, schema)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprint": op3_fingerprint}
