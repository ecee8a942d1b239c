"""Language ID by prediction by partial matching.

Each language has a context tree over the last ``ORDER`` bytes with escape
probabilities (method C, with exclusions). After training the counts are frozen,
so the code length of a byte depends on its context alone and every tree
becomes rows of its language's own table: contexts x byte symbols. A text's code
length in a language is the exact sum of its bytes' table entries; the shortest
code names the language. Every context of the training texts is kept, and any
number of languages.

Training takes at most ``DOCS_PER_LANGUAGE`` whole documents a language, those
with the lowest hash of their id among the labelled training rows. Where the
tables of all languages would exceed ``TABLE_BYTES``, which is what is shipped to
tasks, it takes half as many, and so on.

Defined results: ``und`` with score 0 for null texts, texts without a letter
(Unicode class L) and when nothing was learned; ties go to the first language in
name order; a language that is itself named ``und`` is like any other; repeated
rows each get their own row; other input columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockquery.llm.common import column_bytes, slices, small_batches, text_column
from blockquery.session import table

ORDER = 3
DOCS_PER_LANGUAGE = 400
TABLE_BYTES = 256 << 20
SALTS = 64
SLICE = 1 << 20
UNKNOWN_LANGUAGE = "und"
_LATIN = re.compile(r"[A-Za-z]")


def _windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint64 of each byte and its ORDER predecessors, 9 bits each, 256 standing for "before the text"."""
    n = len(data)
    symbol = data.astype(np.uint64)
    out = symbol.copy()
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER + 1):
        before = np.full(n, 256, np.uint64)
        before[k:] = symbol[: n - k]
        before[place < k] = 256
        out |= before << np.uint64(9 * k)
    return out


def has_letter(text: str) -> bool:
    return _LATIN.search(text) is not None or any(map(str.isalpha, text))


class PpmTable:
    """Frozen code lengths of one language: ``cost[context * symbols + symbol]`` in bits."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        seen = np.zeros(257, bool)
        seen[256] = True
        seen[(keys & np.uint64(511)).astype(int)] = True
        #: symbol 0: before the text; 1: any byte not seen in training; then the seen bytes
        self.code = np.ones(257, np.int32)
        self.code[256] = 0
        bytes_seen = np.flatnonzero(seen[:256])
        self.code[bytes_seen] = np.arange(2, 2 + len(bytes_seen))
        self.size = 2 + len(bytes_seen)
        self.unseen = 256 - len(bytes_seen)
        self._build(self._recode(keys), counts)
        self._index()

    def _recode(self, keys: np.ndarray) -> np.ndarray:
        """Columns: context symbols farthest first, then the symbol itself."""
        parts = [self.code[((keys >> np.uint64(9 * k)) & np.uint64(511)).astype(int)] for k in range(ORDER, -1, -1)]
        return np.stack(parts, axis=1).astype(np.int64) if len(keys) else np.zeros((0, ORDER + 1), np.int64)

    def _pack(self, columns: np.ndarray) -> np.ndarray:
        key = np.zeros(len(columns), np.int64)
        for k in range(columns.shape[1]):
            key = key * self.size + columns[:, k]
        return key

    def _build(self, columns: np.ndarray, counts: np.ndarray) -> None:
        #: contexts[k] has those of order ORDER-k; the last is the empty one
        self.contexts = [np.unique(self._pack(columns[:, k:ORDER])) for k in range(ORDER)] + [np.zeros(1, np.int64)]
        levels = []
        for k in range(ORDER + 1):
            cells, at = np.unique(self._pack(columns[:, k:]), return_inverse=True)
            levels.append((cells, np.bincount(at, weights=counts, minlength=len(cells))))
        parts = [self._bits(own[a : a + 2048], k, levels) for k, own in enumerate(self.contexts) for a in range(0, len(own), 2048)]
        self.cost = np.concatenate(parts).astype(np.float32).ravel()

    def _index(self) -> None:
        """``tail[top[last two symbols], the one before]`` is the row of the longest context that was seen."""
        size = self.size
        third, second, first, _ = self.contexts
        start = np.cumsum([0, *map(len, self.contexts)])
        nearest = np.full(size, start[3], np.int32)
        nearest[first] = start[2] + np.arange(len(first))
        self.top = np.tile(np.arange(size, dtype=np.int32), size)
        self.top[second] = size + np.arange(len(second))
        self.tail = np.empty((size + len(second), size), np.int32)
        self.tail[:size] = nearest[:, None]
        self.tail[size:] = (start[1] + np.arange(len(second)))[:, None]
        self.tail[self.top[third % size**2], third // size**2] = np.arange(len(third))
        self.tail = self.tail.ravel()

    @property
    def nbytes(self) -> int:
        return self.cost.nbytes + self.top.nbytes + self.tail.nbytes

    def _bits(self, contexts: np.ndarray, k: int, levels: list) -> np.ndarray:
        """Code lengths of every symbol in the given contexts of order ORDER-k."""
        size, m = self.size, len(contexts)
        left = np.ones(m)
        done = np.zeros((m, size), bool)
        probability = np.zeros((m, size))
        for level in range(k, ORDER + 1):
            cells, n = levels[level]
            suffix = contexts % size ** (ORDER - level)
            want = suffix[:, None] * size + np.arange(size)[None, :]
            at = np.minimum(np.searchsorted(cells, want), max(len(cells) - 1, 0))
            count = np.where(cells[at] == want, n[at], 0.0) if len(cells) else np.zeros((m, size))
            count[done] = 0
            total, distinct = count.sum(axis=1), (count > 0).sum(axis=1)
            scale = np.where(total > 0, left / np.maximum(total + distinct, 1), 0)
            probability += count * scale[:, None]
            left = np.where(total > 0, left * distinct / np.maximum(total + distinct, 1), left)
            done |= count > 0
        rest = 256 - done[:, 2:].sum(axis=1)
        probability[~done] = np.broadcast_to((left / np.maximum(rest, 1))[:, None], (m, size))[~done]
        return -np.log2(np.maximum(probability, 1e-30))

    def bits(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Bits of each byte; ``begins[k]`` tells which bytes have at most k before them in their text."""
        code = self.code[data]
        before = []
        for k in range(1, ORDER + 1):
            symbol = np.zeros(len(code), np.int32)
            symbol[k:] = code[:-k]
            symbol[begins[k - 1]] = 0
            before.append(symbol)
        key = before[1] * self.size
        key += before[0]
        row = self.top[key] * self.size
        row += before[2]
        row = self.tail[row] * self.size
        row += code
        return self.cost[row]


class Scorer:
    """Code lengths of whole texts in every language."""

    def __init__(self, tables: dict[str, PpmTable]):
        self.languages = sorted(tables)
        self.tables = [tables[x] for x in self.languages]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages) sums of bits; the bytes of a long text are scored in pieces."""
        out = np.zeros((len(offsets) - 1, len(self.tables)))
        for a in range(0, len(data), SLICE):
            b = min(a + SLICE, len(data))
            lead = max(0, a - ORDER)
            first = np.searchsorted(offsets, a, "right") - 1
            last = np.searchsorted(offsets, b, "left")
            cuts = np.unique(np.clip(offsets[first:last], a, b - 1))
            owner = np.searchsorted(offsets, cuts, "right") - 1
            starts = offsets[np.searchsorted(offsets, lead, "left") : last] - lead
            begins = [np.concatenate([starts + j for j in range(k + 1)]) for k in range(ORDER)]
            begins = [x[x < b - lead] for x in begins]
            for column, one in enumerate(self.tables):
                own = one.bits(data[lead:b], begins)
                out[owner, column] += np.add.reduceat(own, cuts - lead, dtype=np.float64)
        return out


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE
) -> dict[str, PpmTable]:
    """Context trees by language from at most ``docs_per_language`` labelled documents of each language."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    order = (F.xxhash64("doc_id"), "doc_id")
    # The lowest of each language are among the lowest of its parts, so that no task has all rows of one language.
    part = labelled.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).alias("salt"))
    for keys in (("lang", "salt"), ("lang",)):
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= docs_per_language)
    ids = F.broadcast(part.select("doc_id", F.col("lang").alias("lang_")).distinct())
    sampled = labelled.join(ids, (labelled.doc_id == ids.doc_id) & (labelled.lang == ids.lang_), "left_semi").select("lang", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = text_column(batch, "text")
            for a, b in slices(texts):
                data, offsets = column_bytes(texts.slice(a, b - a))
                windows = _windows(data, offsets)
                for lang in sorted(set(langs[a:b])):
                    own = np.repeat([x == lang for x in langs[a:b]], np.diff(offsets))
                    keys, n = np.unique(windows[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )

    summed = sampled.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = summed.toArrow().sort_by("lang")
    langs = np.array(found["lang"].to_pylist(), object)
    grams, n = found["gram"].to_numpy().astype(np.uint64), found["n"].to_numpy()
    cuts = [*np.flatnonzero(np.append(True, langs[1:] != langs[:-1])[: len(langs)]), len(langs)]
    tables, size = {}, 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        tables[langs[a]] = PpmTable(grams[a:b], n[a:b])
        size += tables[langs[a]].nbytes
        if size > TABLE_BYTES and docs_per_language > 1:
            return train(docs, id_col, text_col, lang_col, docs_per_language // 2)
    return tables


def held_out(doc_id) -> F.Column:
    """Rows that no model is trained on: crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: dict[str, PpmTable], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score, bits_per_byte. One pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            texts = text_column(batch, "text")
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                lang, score, rate = classify(scorer, part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("held_out").slice(a, b - a),
                        pa.array(lang, pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(rate, pa.float64()),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, model: dict[str, PpmTable], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language; one pass, no shuffle."""
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            texts = text_column(batch, text_col)
            for a, b in slices(texts):
                _, score, _ = classify(scorer, texts.slice(a, b - a))
                yield batch.slice(a, b - a).filter(pa.array([x > 0 for x in score], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(scorer: Scorer, texts) -> tuple[list[str], list[float], list[float]]:
    """Language, posterior under an even prior, and bits per byte of each text of a large_string array."""
    languages = scorer.languages
    data, offsets = column_bytes(texts)
    letters = [has_letter(t) for t in texts.to_pylist()]
    if not languages:
        return [UNKNOWN_LANGUAGE] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    bits = scorer.bits(data, offsets)
    best = bits.argmin(axis=1)
    least = bits.min(axis=1)
    posterior = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(axis=1)
    rate = least / np.maximum(np.diff(offsets), 1)
    lang = [languages[i] if ok else UNKNOWN_LANGUAGE for i, ok in zip(best, letters, strict=True)]
    return lang, [float(p) if ok else 0.0 for p, ok in zip(posterior, letters, strict=True)], rate.tolist()


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


QUERIES = {"op5_language_id": op5_language_id}
