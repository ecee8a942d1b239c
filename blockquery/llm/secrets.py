"""Secret scans: fixed patterns plus character Markov models compared by log-likelihood ratio.

Two first-order character models are trained from labelled samples: random
strings (a seeded generator over the alphabets that keys are drawn from, and the
values that the fixed patterns find in sampled documents) and ordinary
identifiers (the other tokens of six characters or more in them). A token that no
pattern covers and that has 16 characters or more (a shorter one does not hold
evidence enough) is added as kind ``markov`` if the random model's log-likelihood
exceeds the ordinary one's by ``MIN_RATIO`` in all and ``MIN_PER_CHAR`` a
character.

The training sample is bounded by ``SAMPLE_DOCS`` documents, those with the
lowest hash of their id; the scan itself covers every whole text.

Defined results: null and empty texts have no spans; with an empty table the
models rest on the generator and an even prior; equal texts have equal spans;
other input columns pass through ``redact_secrets`` untouched and are ignored by
``scan_secrets``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.llm.common import text_column
from blockquery.session import table

SAMPLE_DOCS = 2000
GENERATED = 4000
MIN_RATIO = 12.0
MIN_PER_CHAR = 0.4
MASK = "[SECRET]"

# Fixed values of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")
ASSIGN_VALUE_MIN, ACCESS_MIN = 6, 20
KINDS = ("assign", "access", "hex", "markov")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
STATES = len(ALPHABET) + 1
_CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each fixed pattern, failing ones dropped, by start and kind."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE_MIN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _free(pattern: re.Pattern, text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Matches of a token pattern that overlap no base span; both go from left to right."""
    edges = sorted((a, b) for _, a, b in base)
    k, covered = 0, 0
    for m in pattern.finditer(text):
        # Spans that begin before the match ends: only the furthest end among them matters.
        while k < len(edges) and edges[k][0] < m.end():
            covered = max(covered, edges[k][1])
            k += 1
        if covered <= m.start():
            yield m.start(), m.end()


def transitions(strings: list[str]) -> np.ndarray:
    """Counts of character pairs, state 0 before the first character."""
    counts = np.zeros((STATES, STATES), np.int64)
    for s in strings:
        codes = [0, *(_CODE[c] for c in s if c in _CODE)]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return counts


def generated_random(n: int = GENERATED, seed: int = 20) -> list[str]:
    """Labelled random strings over the alphabets that keys are drawn from."""
    draw = np.random.Generator(np.random.PCG64(seed))
    kinds = (ALPHABET[52:62] + "abcdef", ALPHABET[:26] + "234567", ALPHABET[:62], ALPHABET[:64])
    out = []
    for i in range(n):
        letters = kinds[i % len(kinds)]
        out.append("".join(letters[k] for k in draw.integers(0, len(letters), int(draw.integers(16, 49)))))
    return out


class MarkovRatio:
    """Log-likelihood ratio of the random-string model against the ordinary one, frozen after training."""

    def __init__(self, random_counts: np.ndarray, ordinary_counts: np.ndarray):
        def logs(counts: np.ndarray) -> np.ndarray:
            smooth = counts + 0.5
            return np.log(smooth / smooth.sum(axis=1, keepdims=True))

        ratio = logs(random_counts) - logs(ordinary_counts)
        self.step = {(a, b): float(ratio[i, j]) for a, i in {"": 0, **_CODE}.items() for b, j in _CODE.items()}

    def score(self, token: str) -> float:
        return sum(map(self.step.__getitem__, zip(["", *token[:-1]], token, strict=True)))

    def is_secret(self, token: str) -> bool:
        total = self.score(token)
        return total >= MIN_RATIO and total >= MIN_PER_CHAR * len(token)


def all_spans(text: str, model: MarkovRatio) -> list[Span]:
    """Base spans and the model's, by start and kind."""
    base = base_spans(text)
    added = [("markov", a, b) for a, b in _free(CANDIDATE, text, base) if model.is_secret(text[a:b])]
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> MarkovRatio:
    """Models from at most ``sample_docs`` documents and the generator; pair counts are summed by Spark."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = F.xxhash64(F.col("doc_id"))
    chosen = rows.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(order, "doc_id").limit(sample_docs).distinct()
    sampled = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            secret, plain = [], []
            for text in text_column(batch, "text").to_pylist():
                base = base_spans(text)
                secret += [ASSIGN.fullmatch(text[a:b])[2] if kind == "assign" else text[a:b] for kind, a, b in base]
                plain += [text[a:b] for a, b in _free(ORDINARY, text, base)]
            counts = np.concatenate([transitions(secret).ravel(), transitions(plain).ravel()])
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], names=["cell", "n"])

    total = np.zeros(2 * STATES * STATES, np.int64)
    for cell, n in sampled.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        total[cell] = n
    found, ordinary = total.reshape(2, STATES, STATES)
    return MarkovRatio(found + transitions(generated_random()), ordinary)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, model: MarkovRatio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_markov. One pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [all_spans(t.as_py(), model) for t in text_column(batch, "text")]
            n = {k: pa.array([sum(s[0] == k for s in x) for x in found], pa.int64()) for k in KINDS}
            base = [joined([s for s in x if s[0] != "markov"]) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    n["assign"],
                    n["access"],
                    n["hex"],
                    pa.array([sha256(x.encode()).hexdigest() for x in base], pa.string()),
                    pa.array([joined(x) for x in found], pa.string()),
                    n["markov"],
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
            )

    return rows.mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each maximal run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, model: MarkovRatio, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span of a secret masked; null texts stay null."""
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            old = batch.column(at)
            new = [None if t is None else masked(t, all_spans(t, model)) for t in (x.as_py() for x in old)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, old.type))

    return docs.mapInArrow(run, schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, train(docs))


QUERIES = {"op6_secret_scan": op6_secret_scan}
