"""Removal of repeated byte strings by suffix arrays over content-defined shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else. Equal strings hold the same least hash of their ``GRAM``-byte grams (the
last one of equal hashes), so the string starts that share such an anchor
meet in one shard: each anchor with more than one occurrence sends the region of
the starts it stands for. A shard's distinct regions are suffix-sorted by
external induced sorting (``suffix_sort``), a start whose common prefix with a
neighbouring start reaches ``LENGTH`` is repeated, and copies of a whole region
are counted instead of sorted. Shards are cut between anchors every
``SHARD_BYTES``; one anchor's regions stay together, as large as they are.

Equal texts are one content with a count: all of a repeated content of at least
``LENGTH`` bytes goes, and one copy stands for it in the search.

Defined results: null texts are empty; texts shorter than ``LENGTH`` lose
nothing; equal ids are told apart by content; repeated rows are copies of each
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.llm.common import PrefixHash, column_bytes, forget_powers, slices, text_column
from blockquery.llm.suffix_sort import induced_sort, range_least
from blockquery.session import stored, table

LENGTH = 400
GRAM = 64
SHARD_BYTES = 768 << 10
SLICE = 1 << 20
BROADCAST_BYTES = 48 << 20
ANCHOR = np.dtype([("h", "<u8"), ("start", "<u4"), ("n", "<u2")])
ENTRY = np.dtype([("h", "<u8"), ("key", "<i8"), ("start", "<u4"), ("n", "<u2")])
RUN = np.dtype([("start", "<u4"), ("n", "<u4")])


def anchors(data: np.ndarray, hashes: PrefixHash, a: int, b: int, length: int, gram: int) -> np.ndarray:
    """ANCHOR rows of data[a:b]: an anchor's hash, its first string start (from a) and how many it stands for."""
    n = b - a
    if n < length:
        return np.zeros(0, ANCHOR)
    start = np.arange(a, b - gram + 1)
    h = hashes.spans(start, start + gram)
    # 32 hash bits decide, then the later position: the order inside a string depends on its bytes only.
    value = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    w = length - gram + 1
    padded = np.full(-(-len(value) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(value)] = value
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
    cuts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    out = np.zeros(len(cuts), ANCHOR)
    out["h"] = h[(np.uint64(0xFFFFFFFF) - (least[cuts] & np.uint64(0xFFFFFFFF))).astype(np.int64)]
    out["start"] = cuts
    out["n"] = np.diff(np.append(cuts, count))
    return out


def content_key(hashes: PrefixHash, offsets: np.ndarray) -> np.ndarray:
    return hashes.spans(offsets[:-1], offsets[1:]).view(np.int64)


def scan_contents(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Per row: doc_id, n_bytes, key (hash of the whole text) and its anchors."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_column(batch, "text")
            for a, b in slices(texts, SLICE):
                data, offsets = column_bytes(texts.slice(a, b - a))
                hashes = PrefixHash(data)
                found = [anchors(data, hashes, x, y, length, gram).tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(offsets)), pa.array(content_key(hashes, offsets)), pa.array(found, pa.binary())],
                    names=["doc_id", "n_bytes", "key", "anchors"],
                )
                del hashes
                forget_powers()

    return rows.mapInArrow(run, "doc_id long, n_bytes long, key long, anchors binary")


def shared_anchors(contents: DataFrame, ranges: int) -> DataFrame:
    """(key, wanted): per content the anchors that occur more than once anywhere, packed."""

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = [np.frombuffer(x, ANCHOR) for x in part.column("anchors").to_pylist()]
                rows = np.zeros(sum(map(len, found)), ENTRY)
                for name in ("h", "start", "n"):
                    rows[name] = np.concatenate([x[name] for x in found]) if found else 0
                rows["key"] = np.repeat(part.column("key").to_numpy(), [len(x) for x in found])
                place = ((rows["h"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                rows = rows[order]
                used, cuts = np.unique(place[order], return_index=True)
                blobs = [x.tobytes() for x in np.split(rows, cuts[1:])] if len(used) else []
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "entries"])

    def meet(batches):
        import pyarrow as pa

        def flush(blobs):
            rows = np.frombuffer(b"".join(blobs), ENTRY)
            rows = rows[np.argsort(rows["h"], kind="stable")]
            cuts = np.flatnonzero(np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]]))
            size = np.diff(np.append(cuts, len(rows)))
            rows = rows[np.repeat(size > 1, size)]
            rows = rows[np.argsort(rows["key"], kind="stable")]
            keys, cuts = np.unique(rows["key"], return_index=True)
            plain = np.zeros(len(rows), ANCHOR)
            for name in ("h", "start", "n"):
                plain[name] = rows[name]
            blobs = [x.tobytes() for x in np.split(plain, cuts[1:])] if len(keys) else []
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "wanted"])

        current, blobs = None, []
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if blobs and r != current:
                    yield flush(blobs)
                    blobs = []
                current = r
                blobs.append(blob)
        if blobs:
            yield flush(blobs)

    routed = contents.select("key", "anchors").mapInArrow(route, "range long, entries binary")
    met = routed.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(meet, "key long, wanted binary")
    return met.groupBy("key").agg(F.collect_list("wanted").alias("wanted"))


def small(df: DataFrame, size) -> DataFrame:
    """Broadcast if the given size column adds up to at most BROADCAST_BYTES, otherwise joined by a shuffle."""
    total = df.agg(F.sum(size + 24)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def regions(rows: DataFrame, contents: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, key, start, n, bytes): the region of each shared anchor, once for each content."""
    one_row = contents.groupBy("key").agg(F.min_by(F.struct("doc_id"), F.coalesce("doc_id", F.lit(-1))).alias("one"))
    ask = stored(wanted.join(one_row, "key").select(F.col("one.doc_id").alias("id"), "key", "wanted"), "ask")
    ask = ask.groupBy("id").agg(F.collect_list(F.struct("key", "wanted")).alias("asked"))
    ask = small(ask, F.aggregate("asked", F.lit(0).cast("long"), lambda t, x: t + F.size(x["wanted"]) * 8 + F.aggregate(x["wanted"], F.lit(0).cast("long"), lambda u, y: u + F.octet_length(y))))
    met = rows.join(ask, rows.doc_id.eqNullSafe(ask.id)).select("text", "asked")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_column(batch, "text")
            asked = batch.column("asked").to_pylist()
            for a, b in slices(texts, SLICE):
                data, offsets = column_bytes(texts.slice(a, b - a))
                keys = content_key(PrefixHash(data), offsets)
                out: list[tuple] = []
                for k, own, x in zip(asked[a:b], keys, offsets[:-1], strict=True):
                    for ask_ in k:
                        if ask_["key"] == own:
                            found = np.frombuffer(b"".join(ask_["wanted"]), ANCHOR)
                            for h, start, n in found.tolist():
                                out.append((np.uint64(h).astype(np.int64), int(own), start, n, data[x + start : x + start + n + length - 1].tobytes()))
                    if len(out) > 4000:
                        yield _region_batch(pa, out)
                        out = []
                yield _region_batch(pa, out)

    found = met.mapInArrow(run, "h long, key long, start long, n long, bytes binary")
    # Repeated rows of one id and content would each send its regions: such a content is marked whole
    # already, so what it adds to a shard may come twice.
    return found


def _region_batch(pa, out):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*out, strict=True) if out else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["h", "key", "start", "n", "bytes"])


class Shard:
    """Distinct regions of consecutive anchors and the distinct places that hold them."""

    def __init__(self, length: int):
        self.length, self.size = length, 0
        self.index: dict[tuple[int, bytes], int] = {}
        self.places: list[list[tuple[int, int]]] = []

    def add(self, h: int, key: int, start: int, region: bytes) -> None:
        at = self.index.setdefault((h, region), len(self.places))
        if at == len(self.places):
            self.places.append([])
            self.size += len(region)
        if (key, start) not in self.places[at][-1:]:
            self.places[at].append((key, start))

    def repeated(self):
        """(key, first start, number) runs of repeated starts."""
        regions = [r for _, r in self.index]
        lengths = np.array([len(r) for r in regions], np.int64)
        flags = self._sorted_flags(regions, lengths)
        base = np.concatenate([[0], np.cumsum(lengths + 1)])
        for k, places in enumerate(self.places):
            n = int(lengths[k]) - self.length + 1
            own = np.ones(n, bool) if len(places) > 1 else flags[base[k] : base[k] + n]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            for key, start in places:
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    yield key, start + int(a), int(b - a)

    def _sorted_flags(self, regions: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Starts of the joined regions whose first LENGTH bytes another start has too."""
        base = np.concatenate([[0], np.cumsum(lengths + 1)])
        flags = np.zeros(base[-1], bool)
        if len(regions) < 2 and (not regions or lengths[0] <= self.length):
            return flags
        text = np.zeros(base[-1], np.int16)
        for r, a in zip(regions, base[:-1], strict=True):
            text[a : a + len(r)] = np.frombuffer(r, np.uint8)
            text[a : a + len(r)] += 1
        order, prefix = induced_sort(text, self.length)
        starts = np.zeros(len(text), bool)
        for a, n in zip(base[:-1], lengths - self.length + 1, strict=True):
            starts[a : a + n] = True
        at = np.flatnonzero(starts[order])
        if len(at) > 1:
            hit = np.flatnonzero(range_least(prefix, at[:-1] + 1, at[1:]) >= self.length)
            flags[order[at[hit]]] = True
            flags[order[at[hit + 1]]] = True
        return flags


def repeated_starts(found: DataFrame, ranges: int, length: int) -> DataFrame:
    """(key, runs): repeated string starts of each content, packed as RUN rows."""
    ordered = found.repartition(ranges, "h").sortWithinPartitions("h", "key", "start")

    def run(batches):
        import pyarrow as pa

        def flush(shard):
            runs: dict[int, list[tuple[int, int]]] = {}
            for key, start, n in shard.repeated():
                runs.setdefault(key, []).append((start, n))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(runs), pa.int64()), pa.array([np.array(x, RUN).tobytes() for x in runs.values()], pa.binary())], names=["key", "runs"]
            )

        shard, last = Shard(length), None
        for batch in batches:
            for h, key, start, region in zip(*(batch.column(c).to_pylist() for c in ("h", "key", "start", "bytes")), strict=True):
                if shard.size >= SHARD_BYTES and h != last:
                    yield flush(shard)
                    shard = Shard(length)
                last = h
                shard.add(h, key, start, region)
        yield flush(shard)

    return ordered.mapInArrow(run, "key long, runs binary").groupBy("key").agg(F.collect_list("runs").alias("runs"))


def removal_mask(n: int, runs: np.ndarray, length: int) -> np.ndarray:
    """Bytes covered by repeated strings that start in the runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs["start"].astype(np.int64), 1)
    np.add.at(edge, runs["start"].astype(np.int64) + runs["n"] + length - 1, -1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the kept bytes."""
    spark = docs.sparkSession
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = stored(scan_contents(rows, length, gram).where(F.col("n_bytes") >= length), "contents")
    pool = stored(scanned.groupBy("key").agg(F.first("anchors").alias("anchors"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "pool")
    wanted = shared_anchors(pool, ranges)
    found = repeated_starts(regions(rows, pool, wanted, length), ranges, length)
    runs = found.join(pool.where("copies > 1").select("key"), "key", "left_anti")
    whole = pool.where("copies > 1").select("key", F.array().cast("array<binary>").alias("runs"))
    marked = scanned.select("doc_id", "key").distinct().join(runs.unionAll(whole), "key")
    marks = stored(marked.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("key", "runs")).alias("marks")), "marks")
    size = F.aggregate("marks", F.lit(0).cast("long"), lambda t, x: t + 40 + F.aggregate(x["runs"], F.lit(0).cast("long"), lambda u, y: u + 24 + F.octet_length(y)))
    marks = small(marks, size)
    joined = rows.join(marks, rows.doc_id.eqNullSafe(marks.id), "left").select("doc_id", "text", "marks")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_column(batch, "text")
            all_marks = batch.column("marks").to_pylist()
            for a, b in slices(texts, SLICE):
                data, offsets = column_bytes(texts.slice(a, b - a))
                keys = content_key(PrefixHash(data), offsets) if any(all_marks[a:b]) else None
                removed, spans, kept = [], [], []
                for k, (x, y) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    own = data[x:y]
                    mine = [m for m in all_marks[a + k] or () if m["key"] == keys[k]]
                    if mine and not mine[0]["runs"]:
                        gone = np.ones(len(own), bool)
                    elif mine:
                        gone = removal_mask(len(own), np.frombuffer(b"".join(mine[0]["runs"]), RUN), length)
                    else:
                        gone = np.zeros(len(own), bool)
                    removed.append(int(gone.sum()))
                    spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                    kept.append(own[~gone].tobytes() if removed[-1] else own.tobytes())
                columns = [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array(np.diff(offsets)),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array([sha256(x).hexdigest() for x in kept], pa.string()),
                ]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
