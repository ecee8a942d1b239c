"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each a node of the byte's code tree; every
such node has a context tree over the ``DEPTH`` previous bytes. A tree node
estimates by Krichevsky-Trofimov (KT) counts, and the mixture over all depths
weighs each node's estimate against the product of its children's, by the
evidence of the whole training corpus. KT evidence depends on counts alone, so
training is counting: the model is frozen afterwards, and a text's code length
is the sum of its bytes'. A node never seen in training answers as its parent.

Counts and the model stay distributed. Documents fall into blocks of about
``BLOCK_BYTES``; a block sends its distinct (context, byte) keys and its training
counts to ranges that hold whole subtrees below the two nearest bytes, and gets
the code length of each of its keys back. Only the two topmost depths, at most
256 x 255 nodes, are joined on the driver and broadcast: a fixed bound. Word
counts for the base score travel the same way.

Defined results: null texts are empty; a text is its bytes with A-Z lowered,
then one end byte 0, preceded by zeros; with no training rows every decision is
even and c, N and V are 0; rows with equal ids are separate; a null id is
not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.llm.common import Words, column_bytes, mix64, slices, text_column
from blockquery.session import stored, table

DEPTH = 4
TOP = 2
BLOCK_BYTES = 24 << 20
SLICE = 1 << 20
MIN_BLOCKS = 6
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
GRAM, WORD = 0, 1


# ---------------------------------------------------------------- keys of texts


def gram_keys(texts) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bounds): nearest context byte first, then farther ones, then the byte; an end byte closes each text."""
    data, offsets = column_bytes(texts)
    sequence = np.insert(_LOWER[data], offsets[1:], 0).astype(np.uint64)
    bounds = offsets + np.arange(len(offsets))
    place = np.arange(len(sequence)) - np.repeat(bounds[:-1], np.diff(bounds))
    keys = sequence.copy()
    for k in range(1, DEPTH + 1):
        before = np.zeros_like(sequence)
        before[k:] = sequence[: max(len(sequence) - k, 0)]
        before[place < k] = 0
        keys |= before << np.uint64(8 * (DEPTH - k + 1))
    return keys, bounds


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their summed counts."""
    keys, counts = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[cuts], np.add.reduceat(counts, cuts)


def squeezed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys as differences, and one value each, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    raw = len(keys).to_bytes(8, "little") + steps + values.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueezed(blob: bytes, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(raw, dtype, n, 8 + 8 * n)


# ---------------------------------------------------------------- the trees


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n: np.ndarray) -> np.ndarray:
    """Log evidence of (..., 2) bit counts."""
    a, b = n[..., 0].astype(float), n[..., 1].astype(float)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - 1.1447298858494002


class Level:
    """Nodes of one depth for one bit of the byte: keys context << 8 | leading bits with a marker, counts, evidence."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.kt = log_kt(counts)
        self.below = np.zeros(len(keys))
        self.leaf = True

    def mix_in(self, children: Level) -> None:
        """Sum of the children's log evidence."""
        parents = np.searchsorted(self.keys, ((children.keys >> np.uint64(16)) << np.uint64(8)) | (children.keys & np.uint64(255)))
        self.below = np.bincount(parents, weights=children.evidence(), minlength=len(self.keys))
        self.leaf = False

    def evidence(self) -> np.ndarray:
        return self.kt if self.leaf else np.logaddexp(self.kt, self.below) - np.log(2)

    def own_weight(self) -> np.ndarray:
        """Posterior weight of the node's own estimate."""
        return np.ones(len(self.keys)) if self.leaf else 1 / (1 + np.exp(np.clip(self.below - self.kt, -700, 700)))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == wanted if len(self.keys) else np.zeros(len(wanted), bool)
        return at, hit


def node_key(context: np.ndarray, byte: np.ndarray, bit: int) -> np.ndarray:
    """Context and the byte's first ``bit`` bits behind a marker."""
    marker = np.uint64(1 << bit) | (byte >> np.uint64(8 - bit) if bit else np.uint64(0))
    return (context << np.uint64(8)) | marker


def build_levels(keys: np.ndarray, counts: np.ndarray, top: int, bit: int) -> dict[int, Level]:
    """Depths DEPTH down to ``top`` of the trees of one bit, from training counts of full keys."""
    seen = counts > 0
    keys, counts = keys[seen], counts[seen]
    byte = keys & np.uint64(255)
    value = (byte >> np.uint64(7 - bit)) & np.uint64(1)
    levels: dict[int, Level] = {}
    for depth in range(DEPTH, top - 1, -1):
        nodes = node_key(keys >> np.uint64(8 * (DEPTH - depth + 1)), byte, bit)
        distinct, at = np.unique(nodes, return_inverse=True)
        n = np.bincount(at * 2 + value.astype(np.int64), weights=counts, minlength=2 * len(distinct)).reshape(-1, 2)
        levels[depth] = Level(distinct, n)
        if depth < DEPTH:
            levels[depth].mix_in(levels[depth + 1])
    return levels


def estimate(levels: dict[int, Level], depth: int, keys: np.ndarray, bit: int, parent: np.ndarray) -> np.ndarray:
    """Mixture from ``depth`` on of the probability that the bit is 1; ``parent`` answers for unseen nodes."""
    wanted = node_key(keys >> np.uint64(8 * (DEPTH - depth + 1)), keys & np.uint64(255), bit)
    level = levels[depth]
    at, hit = level.find(wanted)
    if not len(level.keys):
        return parent.copy()
    n = level.counts[at]
    own = (n[:, 1] + 0.5) / (n.sum(axis=1) + 1)
    if depth == DEPTH:
        mixed = own
    else:
        w = level.own_weight()[at]
        mixed = w * own + (1 - w) * estimate(levels, depth + 1, keys, bit, own)
    return np.where(hit, mixed, parent)


class TopModel:
    """Depths 0 and 1 of every tree, from the ranges' sums: 256 contexts x 256 markers."""

    def __init__(self, counts: np.ndarray, below: np.ndarray):
        """counts (256, 256, 2) at depth 1; below (256, 256): log evidence of the depth-2 children."""
        n0 = counts.sum(axis=0)
        kt1, kt0 = log_kt(counts), log_kt(n0)
        seen = counts.sum(axis=2) > 0
        evidence1 = np.where(seen, np.logaddexp(kt1, below) - np.log(2), 0)
        below0 = evidence1.sum(axis=0)
        self.own1 = (counts[..., 1] + 0.5) / (counts.sum(axis=2) + 1)
        own0 = (n0[:, 1] + 0.5) / (n0.sum(axis=1) + 1)
        w1 = 1 / (1 + np.exp(np.clip(below - kt1, -700, 700)))
        w0 = 1 / (1 + np.exp(np.clip(below0 - kt0, -700, 700)))
        # p = add + scale * (mixture from depth 2 on); an unseen depth-1 node answers as the root.
        self.add = np.where(seen, w0 * own0 + (1 - w0) * w1 * self.own1, own0[None, :])
        self.scale = np.where(seen, (1 - w0) * (1 - w1), 0.0)


def code_lengths(keys: np.ndarray, counts: np.ndarray, top: TopModel) -> np.ndarray:
    """log10 probability of each key's byte in its context."""
    total = np.zeros(len(keys))
    byte = keys & np.uint64(255)
    nearest = (keys >> np.uint64(8 * DEPTH)).astype(np.int64)
    for bit in range(8):
        levels = build_levels(keys, counts, TOP, bit)
        marker = (np.uint64(1 << bit) | (byte >> np.uint64(8 - bit) if bit else np.uint64(0))).astype(np.int64)
        deep = estimate(levels, TOP, keys, bit, top.own1[nearest, marker])
        one = top.add[nearest, marker] + top.scale[nearest, marker] * deep
        value = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        total += np.log10(np.where(value, one, 1 - one))
    return total


def top_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, counts, below): depth-1 sums of one range; cell is context * 256 + marker."""
    cells, numbers, below = [], [], []
    for bit in range(8):
        level = build_levels(keys, counts, TOP, bit)[TOP]
        cell = ((level.keys >> np.uint64(16)) << np.uint64(8)) | (level.keys & np.uint64(255))
        distinct, at = np.unique(cell, return_inverse=True)
        cells.append(distinct.astype(np.int64))
        numbers.append(np.stack([np.bincount(at, weights=level.counts[:, k], minlength=len(distinct)) for k in (0, 1)], axis=1))
        below.append(np.bincount(at, weights=level.evidence(), minlength=len(distinct)))
    return np.concatenate(cells), np.concatenate(numbers).astype(np.int64), np.concatenate(below)


# ---------------------------------------------------------------- Spark stages


def held_out(doc_id: Column) -> Column:
    """Rows that are not trained on: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def range_of(kind: int, keys: np.ndarray, ranges: int) -> np.ndarray:
    """Grams by their two nearest context bytes, words by their hash."""
    h = mix64(keys >> np.uint64(8 * (DEPTH - 1))) if kind == GRAM else keys
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def block_counts(rows: DataFrame, blocks: int, ranges: int) -> DataFrame:
    """(kind, range, block, blob): a block's distinct keys in a range with their training counts; kind 2 counts documents and tokens."""
    dealt = rows.repartition(blocks, "block").sortWithinPartitions("block")

    def run(batches):
        import pyarrow as pa

        def flush(block, held, n_docs, n_tokens):
            out = []
            for kind in (GRAM, WORD):
                keys, counts = merged(*held[kind])
                place = range_of(kind, keys, ranges)
                order = np.argsort(place, kind="stable")
                keys, counts, place = keys[order], counts[order], place[order]
                used, cuts = np.unique(place, return_index=True)
                for r, k, n in zip(used, np.split(keys, cuts[1:]), np.split(counts, cuts[1:]), strict=True) if len(used) else ():
                    out.append((kind, int(r), block, squeezed(k, n.astype("<u4")), 0, 0))
            out.append((2, 0, block, b"", n_docs, n_tokens))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
                names=["kind", "range", "block", "blob", "n_docs", "n_tokens"],
            )

        current, held, n_docs, n_tokens = None, None, 0, 0
        for batch in batches:
            owners = batch.column("block").to_numpy()
            for block in np.unique(owners):
                at = np.flatnonzero(owners == block)
                part = batch.slice(int(at[0]), len(at))
                if block != current:
                    if current is not None:
                        yield flush(current, held, n_docs, n_tokens)
                    current, held, n_docs, n_tokens = int(block), {GRAM: ([], []), WORD: ([], [])}, 0, 0
                texts = text_column(part, "text")
                train = ~np.array(part.column("held_out").to_pylist(), bool)
                for a, b in slices(texts, SLICE):
                    own = texts.slice(a, b - a)
                    keys, bounds = gram_keys(own)
                    words = Words(own)
                    for kind, k, lengths in ((GRAM, keys, np.diff(bounds)), (WORD, words.hashes(), np.diff(words.bounds))):
                        trained = np.repeat(train[a:b], lengths)
                        for mask, unit in ((trained, 1), (~trained, 0)):
                            distinct, n = np.unique(k[mask], return_counts=True)
                            held[kind][0].append(distinct)
                            held[kind][1].append(n * unit)
                        if sum(map(len, held[kind][0])) > 1 << 21:
                            keys_, counts_ = merged(*held[kind])
                            held[kind] = ([keys_], [counts_])
                    n_docs += int(train[a:b].sum())
                    n_tokens += int((np.diff(words.bounds) + 1)[train[a:b]].sum())
        if current is not None:
            yield flush(current, held, n_docs, n_tokens)

    return dealt.mapInArrow(run, "kind long, range long, block long, blob binary, n_docs long, n_tokens long")


def _ranges(batches):
    """(kind, range), blocks, key and count arrays, of each range out of sorted batches."""
    current, blocks, blobs = None, [], []
    for batch in batches:
        for kind, r, block, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "range", "block", "blob")), strict=True):
            if blocks and (kind, r) != current:
                yield current, blocks, blobs
                blocks, blobs = [], []
            current = (kind, r)
            blocks.append(block)
            blobs.append(unsqueezed(blob, "<u4"))
    if blocks:
        yield current, blocks, blobs


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(MIN_BLOCKS, -(-size // BLOCK_BYTES))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    counts = stored(block_counts(rows, blocks, ranges), "ctw-counts")
    totals = counts.where("kind = 2").agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    train_docs, train_tokens = totals[0] or 0, totals[1] or 0
    by_range = counts.where("kind < 2").select("kind", "range", "block", "blob").repartition(ranges, "kind", "range").sortWithinPartitions("kind", "range", "block")

    def sums(batches):
        import pyarrow as pa

        for (kind, _), _, arrays in _ranges(batches):
            keys, n = merged([k for k, _ in arrays], [c.astype(np.int64) for _, c in arrays])
            if kind == WORD:
                cell, number, below = np.array([-1]), np.array([[int((n > 0).sum()), 0]]), np.zeros(1)
            else:
                cell, number, below = top_sums(keys, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(number[:, 0].astype(np.int64)), pa.array(number[:, 1].astype(np.int64)), pa.array(below)],
                names=["cell", "zeros", "ones", "below"],
            )

    grouped = by_range.mapInArrow(sums, "cell long, zeros long, ones long, below double").groupBy("cell")
    top = grouped.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toPandas()
    vocabulary = int(top.zeros[top.cell < 0].sum()) + (train_docs > 0)
    top = top[top.cell >= 0]
    number, below = np.zeros((1 << 16, 2)), np.zeros(1 << 16)
    number[top.cell.to_numpy()] = top[["zeros", "ones"]].to_numpy()
    below[top.cell.to_numpy()] = top.below.to_numpy()
    model = spark.sparkContext.broadcast(TopModel(number.reshape(256, 256, 2), below.reshape(256, 256)))

    def answers(batches):
        import pyarrow as pa

        for (kind, _), owners, arrays in _ranges(batches):
            keys, n = merged([k for k, _ in arrays], [c.astype(np.int64) for _, c in arrays])
            values = code_lengths(keys, n, model.value) if kind == GRAM else n.astype(np.float64)
            blobs = [squeezed(k, values[np.searchsorted(keys, k)].astype("<f4" if kind == GRAM else "<u4")) for k, _ in arrays]
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int64()), pa.array([kind] * len(owners), pa.int64()), pa.array(blobs, pa.binary())], names=["block", "kind", "blob"]
            )

    none = F.lit(None)
    replies = by_range.mapInArrow(answers, "block long, kind long, blob binary").select(
        "block", "kind", "blob", none.cast("long").alias("doc_id"), none.cast("string").alias("text"), none.cast("boolean").alias("held_out")
    )
    texts = rows.select("block", F.lit(2).cast("long").alias("kind"), none.cast("binary").alias("blob"), "doc_id", "text", "held_out")
    met = replies.unionAll(texts).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    denominator = float(np.log10(train_tokens + vocabulary + 1))
    end_known, end_log = int(train_docs > 0), float(np.log10(train_docs + 1))

    def score(batches):
        import pyarrow as pa

        current, tables, found = None, {}, {GRAM: [], WORD: []}
        for batch in batches:
            owners, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            change = np.flatnonzero((np.diff(owners) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, len(owners)], strict=True):
                if lo == hi:
                    continue
                part, block, kind = batch.slice(lo, hi - lo), owners[lo], kinds[lo]
                if block != current:
                    current, tables, found = block, {}, {GRAM: [], WORD: []}
                if kind < 2:
                    found[kind] += [unsqueezed(x, "<f4" if kind == GRAM else "<u4") for x in part.column("blob").to_pylist()]
                    continue
                if not tables:
                    for k in (GRAM, WORD):
                        keys = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in found[k])])
                        values = np.concatenate([np.zeros(0), *(y for _, y in found[k])])
                        order = np.argsort(keys)
                        tables[k] = (keys[order], values[order])
                    found = {GRAM: [], WORD: []}
                own = text_column(part, "text")
                for a, b in slices(own, SLICE):
                    texts_ = own.slice(a, b - a)
                    keys, bounds = gram_keys(texts_)
                    words = Words(texts_)
                    grams, lengths = tables[GRAM]
                    bits = lengths[np.searchsorted(grams, keys)]
                    total = np.add.reduceat(bits, bounds[:-1], dtype=np.float64)
                    known_words, known_counts = tables[WORD]
                    h = words.hashes()
                    c = known_counts[np.searchsorted(known_words, h)] if len(h) else np.zeros(0)
                    owner, n = words.owner(), b - a
                    n_tokens = np.diff(words.bounds) + 1
                    n_known = np.bincount(owner, weights=c > 0, minlength=n).astype(np.int64) + end_known
                    base = np.bincount(owner, weights=np.log10(c + 1), minlength=n) + end_log - n_tokens * denominator
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").slice(a, n),
                            part.column("held_out").slice(a, n),
                            pa.array(n_tokens.astype(np.int64)),
                            pa.array(n_known),
                            pa.array(np.full(n, train_tokens), pa.int64()),
                            pa.array(base),
                            pa.array(total),
                            pa.array(-total / np.log10(2) / np.diff(bounds)),
                        ],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
                    )

    return met.select("block", "kind", "blob", "doc_id", "text", "held_out").mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    )


def op7_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ctw_score": op7_ctw_score}
