"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words are counted over all documents.
2. The benchmark's passages (items and their halves) are TF-IDF rows over its
   vocabulary, with presence as term frequency. A randomised SVD with power
   iterations, whose products with the distributed rows are summed over
   partitions, gives ``RANK`` latent directions.
3. Every document is cut into overlapping windows at the scales of the items'
   lengths. A window whose shared words cannot reach the cosine ``COSINE`` with
   any item of the scale is passed over; the others are projected, and an item
   is a candidate if their latent cosine, relative to the share of the item
   that the latent directions hold, reaches it. The cosine sinks where many
   documents hold an item, as its words then weigh less than those around it.
   So a window is a candidate too if the words around it hold enough of the
   item's weight for step 4, however much else they hold.
4. A candidate is verified on the words around the window: the idf-weighted
   longest common subsequence must cover ``LCS_SURE`` of the item, or
   ``LCS_MAYBE`` of it together with ``ANSWER`` of the item's answer words (the
   words after an answer marker, otherwise those of the last sentence).

The benchmark is the stated query set: it is shipped to tasks in blocks of at
most ``BLOCK_ITEMS`` items after a check of its size, one search of all
documents a block.

Defined results: null and empty texts match nothing; items without a word are
never found; words outside the benchmark weigh as its median word; equal pairs
are reported once with their best window; rows with one id are one document; an
empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.llm.common import Words, slices, text_column
from blockquery.session import stored, table

RANK = 256
POWER_ITERATIONS = 2
COSINE = 0.35
LCS_SURE, LCS_MAYBE, ANSWER = 0.6, 0.4, 0.8
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 32 << 20
BLOCK_WORDS = 1 << 16
SCALE_MIN = 16
BROADCAST_IDS = 500_000
SHARE_EVENTS = 1 << 20
_ANSWER = re.compile(r"\banswer\s*[:=]\s*(?P<answer>.+)\Z", re.I | re.S)
_SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*\Z", re.S)


def scale_of(n_words: int) -> int:
    """Window length for an item: the next power of two, at least SCALE_MIN."""
    return max(SCALE_MIN, 1 << (n_words - 1).bit_length())


def answer_part(text: str) -> str:
    """What follows an answer marker, otherwise the last sentence."""
    found = _ANSWER.search(text)
    if found:
        return found["answer"]
    last = _SENTENCE.search(text.rstrip())
    return last[0] if last else text


def _hashes(texts: list[str]) -> list[np.ndarray]:
    import pyarrow as pa

    words = Words(pa.array(texts, pa.large_string()))
    h = words.hashes()
    return [h[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]


class Benchmark:
    """Items of one block, their vocabulary, weights and latent vectors."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [t for _, t in items]
        hashes = _hashes(texts)
        kept = [k for k, h in enumerate(hashes) if len(h)]
        self.ids = np.array([items[k][0] for k in kept], np.int64)
        self.words = [hashes[k] for k in kept]
        answers = _hashes([answer_part(texts[k]) for k in kept])
        self.answers = [np.unique(a) if len(a) else np.unique(w) for a, w in zip(answers, self.words, strict=True)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.scales = np.array([scale_of(len(w)) for w in self.words], np.int64)
        self.idf = np.ones(len(self.vocabulary))
        self.other = 1.0
        self.basis = np.zeros((len(self.vocabulary), 0), np.float32)
        # Three hash bits in four are free of vocabulary words: most words stop here.
        self.filter = np.zeros(1 << 18, bool)
        self.filter[(self.vocabulary >> np.uint64(46)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary index of each word hash, -1 outside."""
        out = np.full(len(h), -1, np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.filter[(h >> np.uint64(46)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == h[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def set_frequencies(self, frequency: np.ndarray, n_docs: int) -> None:
        self.idf = np.log((n_docs + 1) / (frequency + 1)) + 0.05
        self.other = float(np.median(self.idf)) if len(self.idf) else 1.0

        norm = np.array([np.sqrt((self.idf[np.unique(np.searchsorted(self.vocabulary, w))] ** 2).sum()) for w in self.words])
        self.shortest = {int(x): float(norm[self.scales == x].min()) for x in np.unique(self.scales)}

        self._index_rare_words()

    def _index_rare_words(self) -> None:
        """Postings of each item's rarer words with their share of its weight.

        The words left out, its most frequent ones, have at most half of LCS_MAYBE
        together: where LCS_MAYBE is reached, the rarer ones have the rest (``least``).
        """
        found = []
        self.least = np.zeros(len(self.words))
        for k, w in enumerate(self.words):
            columns, count = np.unique(np.searchsorted(self.vocabulary, w), return_counts=True)
            share = self.idf[columns] * count
            share /= share.sum()
            order = np.argsort(self.idf[columns], kind="stable")
            left = np.cumsum(share[order])
            n = int(np.searchsorted(left, LCS_MAYBE / 2, "right"))
            self.least[k] = LCS_MAYBE - (left[n - 1] if n else 0) - 1e-9
            found.append((columns[order[n:]], np.full(len(order) - n, k), share[order[n:]]))
        columns, items, shares = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(columns, kind="stable")
        self.posting_items, self.posting_shares = items[order], shares[order]
        self.posting_bounds = np.searchsorted(columns[order], np.arange(len(self.vocabulary) + 1))

    def item_rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sparse unit rows of the items: (columns, values)."""
        return [self.row_of(w) for w in self.words]

    def passage_rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sparse unit rows of the items and of their halves."""
        halves = [part for w in self.words if len(w) > 1 for part in np.array_split(w, 2)]
        return self.item_rows() + [self.row_of(w) for w in halves]

    def row_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.unit(np.unique(np.searchsorted(self.vocabulary, words)), 0.0)

    def unit(self, columns: np.ndarray, outside: float) -> tuple[np.ndarray, np.ndarray]:
        values = self.idf[columns]
        return columns, values / np.sqrt(values @ values + outside)

    def finish(self, basis: np.ndarray) -> None:
        self.basis = basis.astype(np.float32)
        latent = [v @ self.basis[c] for c, v in self.item_rows()]
        self.latent = np.stack(latent) if latent else np.zeros((0, self.basis.shape[1]), np.float32)
        # A window equal to the item scores 1, however much of the item the directions hold.
        self.latent /= np.maximum((self.latent**2).sum(axis=1, keepdims=True), 1e-9)

    def windows(self, words: Words, places: np.ndarray):
        """(scale, start words, end words, owners) of windows that may reach the cosine, with the sums of outside weight."""
        inside = np.where(places >= 0, self.idf[places] if len(self.idf) else 0, 0) ** 2
        outside = np.where(places >= 0, 0, self.other**2)
        energy_in, energy_out = (np.concatenate([[0], np.cumsum(x)]) for x in (inside, outside))
        n_words = np.diff(words.bounds)
        for scale in np.unique(self.scales):
            step = scale // 4
            n = np.where(n_words > 0, np.maximum(1, -(-(n_words - scale) // step) + 1), 0)
            owner = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = words.bounds[owner] + k * step
            end = np.minimum(start + scale, words.bounds[owner + 1])
            a, b = energy_in[end] - energy_in[start], energy_out[end] - energy_out[start]
            ok = np.flatnonzero(a >= COSINE * self.shortest[int(scale)] * np.sqrt(a + b) - 1e-9)
            yield int(scale), start[ok], end[ok], owner[ok], energy_out

    def shares(self, words: Words, places: np.ndarray):
        """(owners, items, start words, end words, shares) of windows whose surroundings hold ``least`` of an item."""
        hit = np.flatnonzero(places >= 0)
        fan = np.diff(self.posting_bounds)[places[hit]]
        hit, fan = hit[fan > 0], fan[fan > 0]
        owner = np.searchsorted(words.bounds, hit, "right") - 1
        total = np.cumsum(fan)
        if not len(hit):
            return
        ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1
        lo = 0
        for end, after in zip(ends, [*ends[1:], None], strict=True):
            if after is None or total[after - 1] - (total[lo - 1] if lo else 0) > SHARE_EVENTS:
                yield self._shares(words, hit[lo:end], fan[lo:end], owner[lo:end], places)
                lo = end

    def _shares(self, words: Words, hit, fan, owner, places):
        at = np.arange(fan.sum()) + np.repeat(self.posting_bounds[places[hit]] - np.cumsum(fan) + fan, fan)
        item, share, doc, place = self.posting_items[at], self.posting_shares[at], np.repeat(owner, fan), np.repeat(hit, fan)
        pair = doc * len(self.ids) + item
        _, group = np.unique(pair, return_inverse=True)
        ok = np.bincount(group, share)[group] >= self.least[item]
        item, share, doc, place, pair = item[ok], share[ok], doc[ok], place[ok], pair[ok]
        scale = self.scales[item]
        step, n_words, place = scale // 4, np.diff(words.bounds)[doc], place - words.bounds[doc]
        n = np.maximum(1, -(-(n_words - scale) // step) + 1)
        first = np.maximum(0, (place - scale - scale // 2) // step + 1)
        many = np.minimum(n - 1, (place + scale // 2) // step) - first + 1
        k = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        most = int(n.max(initial=1))
        found, head, group = np.unique(np.repeat(pair, many) * most + k, return_index=True, return_inverse=True)
        total = np.bincount(group, np.repeat(share, many), len(found))
        source = np.repeat(np.arange(len(pair)), many)[head]
        ok = total >= self.least[item[source]]
        source, k = source[ok], found[ok] % most
        start = words.bounds[doc[source]] + k * step[source]
        end = np.minimum(start + scale[source], words.bounds[doc[source] + 1])
        return doc[source], item[source], start, end, total[ok]

    def rows_of(self, start, end, places, energy_out) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for a, b in zip(start, end, strict=True):
            own = places[a:b]
            out.append(self.unit(np.unique(own[own >= 0]), energy_out[b] - energy_out[a]))
        return out


def weighted_lcs(item: np.ndarray, text: np.ndarray, weight: np.ndarray) -> float:
    """Largest summed item weight of a common subsequence."""
    row = np.zeros(len(text) + 1)
    for h, w in zip(item, weight, strict=True):
        taken = np.where(text == h, row[:-1] + w, row[1:])
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], taken))
    return float(row[-1])


def randomised_svd(rows: DataFrame, width: int, rank: int, iterations: int = POWER_ITERATIONS) -> np.ndarray:
    """Right singular vectors (width, rank) of a distributed sparse matrix.

    ``rows(columns binary int32, values binary float32)``; each product with the
    matrix is a sum over partitions of arrays of width x rank.
    """
    context = rows.sparkSession.sparkContext
    draw = np.random.Generator(np.random.PCG64(7))
    test = np.linalg.qr(draw.standard_normal((width, rank)))[0].astype(np.float32)

    def product(matrix: np.ndarray) -> np.ndarray:
        """A'A times the matrix."""
        shared = context.broadcast(matrix)

        def run(batches):
            import pyarrow as pa

            m = shared.value
            total = np.zeros(m.shape, np.float64)
            for batch in batches:
                for c, v in zip(batch.column("columns").to_pylist(), batch.column("values").to_pylist(), strict=True):
                    c, v = np.frombuffer(c, "<i4"), np.frombuffer(v, "<f4")
                    total[c] += np.outer(v, v @ m[c])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = rows.mapInArrow(run, "part binary").toLocalIterator()
        out = np.zeros(matrix.shape)
        for part in parts:
            out += np.frombuffer(part["part"]).reshape(matrix.shape)
        shared.unpersist()
        return out

    for _ in range(iterations):
        test = np.linalg.qr(product(test))[0].astype(np.float32)
    # In the found subspace the Gram matrix is small: its eigenvectors rotate the subspace to singular vectors.
    gram = test.T @ product(test)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return test @ vectors[:, np.argsort(-values)]


def _frequencies(rows: DataFrame, bench: Benchmark) -> tuple[np.ndarray, int]:
    """Documents that hold each vocabulary word, over all documents, and their number."""
    shared = rows.sparkSession.sparkContext.broadcast(bench)

    def run(batches):
        import pyarrow as pa

        b = shared.value
        total, n = np.zeros(len(b.vocabulary), np.int64), 0
        for batch in batches:
            texts = text_column(batch, "text")
            n += batch.num_rows
            for x, y in slices(texts):
                words = Words(texts.slice(x, y - x))
                places = b.places(words.hashes())
                hit = np.flatnonzero(places >= 0)
                owner = np.searchsorted(words.bounds, hit, "right") - 1
                pairs = np.unique(owner * np.int64(len(total)) + places[hit])
                total += np.bincount(pairs % max(len(total), 1), minlength=len(total))
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(places, -1)), pa.array(np.append(total[places], n))], names=["place", "n"])

    found = rows.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(bench.vocabulary), np.int64)
    known = found[found.place >= 0]
    out[known.place.to_numpy()] = known.n.to_numpy()
    return out, int(found[found.place < 0].n.sum())


def _passages(spark: SparkSession, bench: Benchmark) -> DataFrame:
    """Sparse rows of the benchmark's passages, dealt over partitions."""
    packed = [(bytearray(c.astype("<i4").tobytes()), bytearray(v.astype("<f4").tobytes())) for c, v in bench.passage_rows()]
    return spark.createDataFrame(packed, "columns binary, values binary").repartition(8)


def _search(rows: DataFrame, bench: Benchmark) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(bench)

    def run(batches):
        import pyarrow as pa

        b = shared.value
        weight = [b.idf[np.searchsorted(b.vocabulary, w)] for w in b.words]
        by_scale = {int(s): np.flatnonzero(b.scales == s) for s in np.unique(b.scales)}
        for batch in batches:
            texts = text_column(batch, "text")
            ids = batch.column("doc_id").to_pylist()
            for x, y in slices(texts):
                words = Words(texts.slice(x, y - x))
                h = words.hashes()
                places = b.places(h)
                near: dict[tuple[int, int], list[tuple]] = {}
                for scale, start, end, owner, energy_out in b.windows(words, places):
                    items = by_scale[scale]
                    for lo in range(0, len(start), 512):
                        part = slice(lo, lo + 512)
                        latent = np.stack([v @ b.basis[c] for c, v in b.rows_of(start[part], end[part], places, energy_out)])
                        cosine = latent @ b.latent[items].T
                        for p, q in zip(*np.nonzero(cosine >= COSINE), strict=True):
                            k, doc, value = items[q], int(owner[lo + p]), float(cosine[p, q])
                            near.setdefault((doc, k), []).append((value, int(start[lo + p]), int(end[lo + p])))
                full: dict[tuple[int, int], list[tuple]] = {}
                for found in b.shares(words, places):
                    for doc, k, start_word, end_word, value in zip(*(x.tolist() for x in found), strict=True):
                        full.setdefault((doc, k), []).append((value, start_word, end_word))
                out = []
                for doc, k in sorted(near.keys() | full.keys()):
                    scale = int(b.scales[k])
                    # Best first, until one passes: a better aligned one may hold the words in another order.
                    for _, start_word, end_word in (w for c in (near, full) for w in sorted(c.get((doc, k), ()), key=lambda w: -w[0])):
                        a = max(words.bounds[doc], start_word - scale // 2)
                        z = min(words.bounds[doc + 1], end_word + scale // 2)
                        around = h[a:z]
                        if weight[k][np.isin(b.words[k], around)].sum() < LCS_MAYBE * weight[k].sum() - 1e-9:
                            continue
                        lcs = weighted_lcs(b.words[k], around, weight[k]) / weight[k].sum()
                        answer = float(np.isin(b.answers[k], around).mean())
                        if lcs >= LCS_SURE or (lcs >= LCS_MAYBE and answer >= ANSWER):
                            columns, values = b.rows_of([start_word], [end_word], places, energy_out)[0]
                            out.append((ids[x + doc], int(b.ids[k]), float(values @ b.basis[columns] @ b.latent[k]), lcs, answer))
                            break
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                columns = zip(*out, strict=True) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    return rows.mapInArrow(run, "doc_id long, item_id long, cosine double, lcs double, answer double")


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Blocks of the query set, each within the checked size, by item id."""
    block: list[tuple[int, str]] = []
    size, words = 0, set()
    for r in benchmark.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where("i is not null").orderBy("i", "t").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(r["t"]) > BLOCK_CHARS or len(words) >= BLOCK_WORDS):
            yield Benchmark(block)
            block, size, words = [], 0, set()
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        words.update(r["t"].lower().split())
    if block:
        yield Benchmark(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id) of a document that holds a benchmark item, with cosine, lcs and answer."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    found = None
    for bench in benchmark_blocks(benchmark):
        if not len(bench.ids):
            continue
        bench.set_frequencies(*_frequencies(rows, bench))
        rank = min(RANK, len(bench.vocabulary), 3 * len(bench.ids))
        bench.finish(randomised_svd(_passages(docs.sparkSession, bench), len(bench.vocabulary), rank))
        part = _search(rows, bench)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double, answer double")
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of documents that hold no benchmark item."""
    ids = stored(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, id_col, "left_anti").select(docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document of the whole table with the items it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
