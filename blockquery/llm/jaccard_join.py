"""N-gram Jaccard join by a count-vector R-tree.

Two documents link when 7 * |A and B| >= 3 * (|A| + |B|) for their shingle sets
(Jaccard 0.75 or more). Documents with equal sets are one class, represented by
its smallest id. A class's shingles are hashed into groups and the group counts
are a point; the summed coordinate minima of two points bound their overlap
from above, and so do the bounding boxes of an R-tree's nodes. Pairs that
survive are verified on their whole shingle sets.

Which points meet in one tree: any two linked sets share a shingle among the
first n - ceil(3n/4) + 1 of each under any common order of shingles, so a class
is routed by those shingles and every shingle that two classes share gets a
tree. The order puts shingles that are frequent in a bounded sample last (it
affects speed only). Trees of a first round take the first few routing shingles
and join most near copies; later rounds take all of them, but only search
between components that are not joined yet. A round takes for each document the
partner with the best bound, a later one the best few, the last all: no cap is
final. A tree that kept back no pair is finished; later rounds take the others.

Rows reach Python packed; a group above ``BLOCK`` points is ordered by set size
and split into blocks, and the pairs of blocks whose sizes allow a link are
searched, so no task builds a tree of a whole hot group.

Defined results: null and empty texts, or texts without a word, have 0 shingles
and link with nothing; fewer than ``width`` words form one shingle. Ids are
keys: rows with one id and different texts are one node with the links of each
(a row without a word keeps its own id). A null id is compared with nothing and has no component. Repeated rows each get
their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.llm.common import Words, mix64, shingle_sets, slices, small_batches, text_column
from blockquery.llm.graph import components
from blockquery.session import stored, table

WIDTH = 5
FIRST_ROUTES = 4
FREQUENT_SAMPLE = 4000
FREQUENT_SHARE = 1 / 250
LEAF, FANOUT, COARSE = 32, 16, 16
GROUPS = (64, 512)
GROUPS_TOLD = 24
BLOCK = 2048
LEVELS = 64
FIRST_PARTNERS = (1,)
PARTNERS = (1, 8, None)
COMPACT_ROWS = 200_000
CHUNK_ROWS, CHUNK_BYTES = 16_384, 4 << 20
SALTS = 16
BROADCAST_IDS = 500_000
HUB_CHUNK = 128


def prefix_length(n: int) -> int:
    """Routing shingles of a set of n: n - ceil(3n/4) + 1."""
    return n - -(-3 * n // 4) + 1


def group_count(n: int) -> int:
    """Groups of a set of n: the power of two from n/2 on, from n/4 on for large sets, at least ``GROUPS[0]``."""
    half = 1 << max(0, (n - 1).bit_length() - 1)
    return max(GROUPS[0], min(half, max(GROUPS[1], half // 2)))


def count_vector(shingles: np.ndarray) -> bytes:
    """Shingles of each group, four bits each; groups of a smaller power of two are sums of these.

    Where a group holds more than four bits can tell, the groups are made finer.
    """
    groups = group_count(len(shingles))
    while True:
        counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max(initial=0) < 16:
            counts = counts.astype(np.uint8)
            return (counts[0::2] | (counts[1::2] << 4)).tobytes()
        groups *= 2


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """The vector over fewer groups."""
    return vector.reshape(-1, groups).sum(axis=0, dtype=np.int32)


# ---------------------------------------------------------------- the R-tree


class Points:
    """Set sizes and group counts of many points, the counts end to end in one array."""

    def __init__(self, ids: np.ndarray, roots: np.ndarray, sizes: np.ndarray, packed: np.ndarray, cuts: np.ndarray, group=None, all_groups=None):
        """``packed`` holds the vectors' bytes, that of point k from ``cuts[k]`` to ``cuts[k + 1]``.

        With ``group``, that of each point's tree, and ``all_groups``, the least
        ``GROUPS_TOLD`` of those that hold the point (values and cuts), a pair counts
        in the least group that holds both. Where none of those told is shared it
        counts in every group: twice is not wrong, only more to write.
        """
        self.ids, self.roots, self.sizes = ids, roots, sizes.astype(np.int64)
        self.group, self.all_groups = group, all_groups
        self.flat = np.empty(2 * len(packed), np.uint8)
        self.flat[0::2], self.flat[1::2] = packed & 15, packed >> 4
        self.cuts = 2 * cuts
        self.groups = np.diff(self.cuts)
        rows = self.flat.reshape(-1, COARSE)
        self.coarse = np.add.reduceat(rows, self.cuts[:-1] // COARSE, axis=0, dtype=np.int32) if len(ids) else np.zeros((0, COARSE), np.int32)

    def vectors(self, at: np.ndarray, groups: int) -> np.ndarray:
        """The points' vectors over so many groups."""
        out = np.empty((len(at), groups), np.int32)
        for k, point in enumerate(at):
            own = self.flat[self.cuts[point] : self.cuts[point + 1]]
            out[k] = own if len(own) == groups else folded(own, groups)
        return out

    def bounded(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs between components that sizes and summed coordinate minima let link, and bound over sizes.

        Both points of a pair are taken at the groups of the coarser one of the two.
        """
        ok = (self.roots[p] != self.roots[q]) & (4 * np.minimum(self.sizes[p], self.sizes[q]) >= 3 * np.maximum(self.sizes[p], self.sizes[q]))
        p, q = p[ok], q[ok]
        found = [(p[:0], q[:0], np.zeros(0))]
        for a in range(0, len(p), 1 << 16):
            x, y = p[a : a + (1 << 16)], q[a : a + (1 << 16)]
            ok = 7 * np.minimum(self.coarse[x], self.coarse[y]).sum(axis=1) >= 3 * (self.sizes[x] + self.sizes[y])
            x, y = x[ok], y[ok]
            groups = np.minimum(self.groups[x], self.groups[y])
            for g in np.unique(groups):
                at = np.flatnonzero(groups == g)
                step = max(1, (1 << 20) // int(g))
                for lo in range(0, len(at), step):
                    u, v = x[at[lo : lo + step]], y[at[lo : lo + step]]
                    used, place = np.unique(np.concatenate([u, v]), return_inverse=True)
                    counts = self.vectors(used, int(g))
                    sums = np.minimum(counts[place[: len(u)]], counts[place[len(u) :]]).sum(axis=1, dtype=np.int64)
                    total = self.sizes[u] + self.sizes[v]
                    ok = 7 * sums >= 3 * total
                    u, v, share = u[ok], v[ok], sums[ok] / total[ok]
                    ok = self._meet_here(u, v)
                    found.append((u[ok], v[ok], share[ok]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _meet_here(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the tree's group is the least of those that hold both points."""
        if self.all_groups is None:
            return np.ones(len(p), bool)
        values, cuts = self.all_groups
        own = {k: frozenset(values[cuts[k] : cuts[k + 1]].tolist()) for k in np.unique(np.concatenate([p, q])).tolist()}
        return np.array([min(own[a] & own[b], default=g) == g for a, b, g in zip(p.tolist(), q.tolist(), self.group[p].tolist(), strict=True)], bool)


class CountTree:
    """R-tree over some of the points: boxes of ``LEAF`` points, and boxes of ``FANOUT`` of those."""

    def __init__(self, points: Points, members: np.ndarray):
        self.points = points
        sizes, coarse = points.sizes[members], points.coarse[members]
        order = np.lexsort((*coarse.T[:4], sizes))
        # Sort-tile packing: runs by size, then by the coordinates within a run.
        run = max(LEAF, int(np.ceil(np.sqrt(len(order) / LEAF))) * LEAF)
        for a in range(0, len(order), run):
            part = order[a : a + run]
            order[a : a + run] = part[np.lexsort(coarse[part].T[:COARSE])]
        cuts = np.arange(0, len(order), LEAF)
        self.leaves = [members[order[a : a + LEAF]] for a in cuts]
        leaf = (np.maximum.reduceat(coarse[order], cuts, axis=0), np.minimum.reduceat(sizes[order], cuts), np.maximum.reduceat(sizes[order], cuts))
        cuts = np.arange(0, len(self.leaves), FANOUT)
        node = (np.maximum.reduceat(leaf[0], cuts, axis=0), np.minimum.reduceat(leaf[1], cuts), np.maximum.reduceat(leaf[2], cuts))
        self.levels = [leaf, node]

    def _meets(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of boxes may hold linked points."""
        high, least, most = self.levels[level]
        ok = 4 * np.minimum(most[i], most[j]) >= 3 * np.maximum(least[i], least[j])
        return ok & (7 * np.minimum(high[i], high[j]).sum(axis=1) >= 3 * (least[i] + least[j]))

    def leaf_pairs(self) -> Iterator[tuple[int, int]]:
        """Pairs of leaves, one with itself included, that are left by the boxes of both levels."""
        i, j = np.triu_indices(len(self.levels[1][1]))
        ok = self._meets(1, i, j)
        for x, y in zip(i[ok], j[ok], strict=True):
            a = np.arange(x * FANOUT, min((x + 1) * FANOUT, len(self.leaves)))
            b = np.arange(y * FANOUT, min((y + 1) * FANOUT, len(self.leaves)))
            u, v = np.repeat(a, len(b)), np.tile(b, len(a))
            u, v = u[u <= v], v[u <= v]
            ok = self._meets(0, u, v)
            yield from zip(u[ok].tolist(), v[ok].tolist(), strict=True)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, size = [], 0
        for i, j in self.leaf_pairs():
            a, b = self.leaves[i], self.leaves[j]
            u, v = np.nonzero(np.tri(len(a), k=-1, dtype=bool)) if i == j else np.divmod(np.arange(len(a) * len(b)), len(b))
            held.append((a[u], b[v]))
            size += len(u)
            if size > 1 << 17:
                yield self.points.bounded(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield self.points.bounded(*(np.concatenate(c) for c in zip(*held, strict=True)))


def leaf_groups(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of points within each group of at most ``LEAF`` points: a tree that is one leaf."""
    sizes = np.diff(cuts)
    p, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(sizes[(sizes > 1) & (sizes <= LEAF)]):
        first, i, j = cuts[:-1][sizes == n][:, None], *np.tril_indices(n, -1)
        p.append((first + i).ravel())
        q.append((first + j).ravel())
    return np.concatenate(p), np.concatenate(q)


def search(points: Points, cuts: np.ndarray, partners: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, smaller id) pairs between components and the trees that kept pairs back.

    Tree k has the points from ``cuts[k]`` to ``cuts[k + 1]``. Of each point and
    tree the ``partners`` pairs of the best bounds are taken, or all.
    """
    kept_back: list[np.ndarray] = []

    def best(rows: np.ndarray) -> np.ndarray:
        """The first partners of each point by level of the bound, then by id: those of one level choose the same ones."""
        if partners is None:
            return rows
        level = np.floor(rows["score"] * LEVELS)
        rows = rows[np.lexsort((points.ids[rows["y"]], -level, rows["x"]))]
        first = np.flatnonzero(np.append(True, rows["x"][1:] != rows["x"][:-1])[: len(rows)])
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        kept_back.append(rows["x"][place >= partners])
        return rows[place < partners]

    def both(p: np.ndarray, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        rows = np.empty(2 * len(p), [("x", "<i8"), ("y", "<i8"), ("score", "<f8")])
        rows["x"], rows["y"], rows["score"] = np.concatenate([p, q]), np.concatenate([q, p]), np.tile(score, 2)
        return rows

    found = [best(both(*points.bounded(*leaf_groups(cuts))))]
    for k in np.flatnonzero(np.diff(cuts) > LEAF):
        members = np.arange(cuts[k], cuts[k + 1])
        if (points.roots[members] == points.roots[members[0]]).all():
            continue
        held, size = [], 0
        for part in CountTree(points, members).pairs():
            held.append(both(*part))
            size += len(held[-1])
            if size > COMPACT_ROWS and partners is not None:
                held = [best(np.concatenate(held))]
                size = len(held[0]) // 2
        if held:
            found.append(best(np.concatenate(held)))
    rows = np.concatenate(found)
    a, b = points.ids[rows["x"]], points.ids[rows["y"]]
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1) if len(rows) else np.zeros((2, 0), np.int64)
    unfinished = np.unique(np.searchsorted(cuts, np.concatenate([np.zeros(0, np.int64), *kept_back]), "right") - 1)
    return pairs[0], pairs[1], unfinished


# ---------------------------------------------------------------- Spark stages


def frequent_shingles(rows: DataFrame, width: int, sample: int = FREQUENT_SAMPLE, share: float = FREQUENT_SHARE) -> np.ndarray:
    """Shingles held by that share of a bounded sample; they come last in the routing order."""
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    chosen = rows.join(F.broadcast(ids), "doc_id", "left_semi")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_column(batch, "text")
            for a, b in slices(texts):
                sets = shingle_sets(Words(texts.slice(a, b - a)), width)
                keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = chosen.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    least = max(8, int(sample * share))
    return np.sort(np.array([r["h"] for r in counts.where(F.col("n") >= least).select("h").collect()], np.int64).view(np.uint64))


def sketch(rows: DataFrame, width: int, frequent: np.ndarray) -> DataFrame:
    """Per row: doc_id, n, two set hashes, the routing shingles in order, and the count vector."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_column(batch, "text")
            for a, b in slices(texts):
                n, one, two, route, vector = [], [], [], [], []
                for s in shingle_sets(Words(texts.slice(a, b - a)), width):
                    n.append(len(s))
                    one.append(int(mix64(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix64(s ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64).view(np.int64)))
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        s = np.concatenate([s[frequent[at] != s], s[frequent[at] == s]])
                    route.append(s[: prefix_length(len(s))].tobytes() if len(s) else b"")
                    vector.append(count_vector(s) if len(s) else b"")
                columns = [batch.column("doc_id").slice(a, b - a), *(pa.array(c, pa.int64()) for c in (n, one, two)), *(pa.array(c, pa.binary()) for c in (route, vector))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "one", "two", "route", "vector"])

    return rows.mapInArrow(run, "doc_id long, n long, one long, two long, route binary, vector binary")


MEMBER = np.dtype([("doc", "<i8"), ("n", "<i4")])


def routed(reps: DataFrame, first: int | None, ranges: int) -> DataFrame:
    """(range, entries): routing shingles of many classes packed by range of their hash, with id, component and set size."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                routes = [np.frombuffer(x, "<u8")[:first] for x in part.column("route").to_pylist()]
                owner = np.repeat(np.arange(len(routes), dtype=np.uint16), [len(r) for r in routes])
                h = np.concatenate([np.zeros(0, np.uint64), *routes])
                doc, root, n = (part.column(c).to_numpy() for c in ("doc_id", "root", "n"))
                order = np.argsort(h)
                h, owner = h[order], owner[order]
                place = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                keys, cuts = np.unique(place, return_index=True)
                blobs = []
                for x, y in zip(cuts, np.append(cuts[1:], len(h)), strict=True):
                    used, at = np.unique(owner[x:y], return_inverse=True)
                    blobs.append(_packed_entries(h[x:y], at.astype("<u2"), doc[used], root[used], n[used]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "entries"])

    packed = reps.select("doc_id", "root", "n", "route").mapInArrow(run, "range long, entries binary")

    def groups(batches):
        import pyarrow as pa

        for _, blobs in _by_range(batches):
            # Column by column: a range is the most that a task holds.
            parts = [list(c) for c in zip(*map(_unpacked_entries, blobs), strict=True)]
            h, doc, root, n = (np.concatenate(parts.pop(0)) for _ in range(4))
            order = np.lexsort((doc, n, h))
            h, root = h[order], root[order]
            cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            del h
            size = np.diff(np.append(cuts, len(order)))
            mixed = np.maximum.reduceat(root, cuts) != np.minimum.reduceat(root, cuts)
            rows = np.empty(len(order), MEMBER)
            rows["doc"], rows["n"] = doc[order], n[order]
            del root, doc, n, order
            members = mix64(np.ascontiguousarray(rows["doc"]).view(np.uint64))
            name = mix64(np.add.reduceat(members, cuts) ^ size.astype(np.uint64))
            keep = np.flatnonzero(mixed)
            _, once = np.unique(name[keep], return_index=True)
            keep = keep[once]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(name[keep].view(np.int64)),
                    pa.array(size[keep].astype(np.int64)),
                    pa.array([rows[cuts[k] : cuts[k] + size[k]].tobytes() for k in keep], pa.binary()),
                ],
                names=["name", "size", "docs"],
            )

    ordered = packed.repartition(ranges, "range").sortWithinPartitions("range")
    return ordered.mapInArrow(groups, "name long, size long, docs binary").dropDuplicates(["name", "size"])


def _packed_entries(h: np.ndarray, at: np.ndarray, *owners: np.ndarray) -> bytes:
    """Sorted hashes as differences, owners as places in lists of ids, components and set sizes; compressed."""
    steps = np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    sizes = np.array([len(h), len(owners[0])], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes, steps, at.tobytes(), *(x.astype("<i8").tobytes() for x in owners)]))


def _unpacked_entries(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, "<i8", 2)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 16).reshape(8, n).T).view(np.uint64).ravel()
    at = np.frombuffer(raw, "<u2", n, 16 + 8 * n)
    owners = (np.frombuffer(raw, "<i8", m, 16 + 10 * n + 8 * m * k) for k in range(3))
    return np.cumsum(steps, dtype=np.uint64), *(x[at] for x in owners)


def _by_range(batches):
    """Blobs of each range out of sorted batches."""
    current, blobs = None, []
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if blobs and key != current:
                yield current, blobs
                blobs = []
            current = key
            blobs.append(blob)
    if blobs:
        yield current, blobs


def block_pairs(blocks: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Ids of the pairs of blocks, in order of set size, that may hold a link; every block is in one."""
    for i, block in enumerate(blocks):
        low = [k for k in range(i) if 4 * int(blocks[k]["n"][-1]) >= 3 * int(block["n"][0])]
        for k in low:
            yield np.concatenate([block["doc"], blocks[k]["doc"]])
        if not low:
            yield block["doc"]


def tree_members(groups: DataFrame, hub_only: bool) -> DataFrame:
    """(name, tree, doc_id): members of each tree to build; large groups are split.

    With ``hub_only`` a block is searched for itself and the group's middle
    member; otherwise every pair of blocks whose set sizes allow a link gets a
    tree, so all pairs that can link meet.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, trees, docs = [], [], []
            for name, blob in zip(batch.column("name").to_pylist(), batch.column("docs").to_pylist(), strict=True):
                members = np.frombuffer(blob, MEMBER)
                if len(members) <= BLOCK:
                    parts = [members["doc"]]
                else:
                    blocks = np.array_split(members, -(-len(members) // (BLOCK // 2)))
                    if hub_only:
                        parts = [np.unique(np.append(b["doc"], members["doc"][len(members) // 2])) for b in blocks]
                    else:
                        parts = block_pairs(blocks)
                for k, part in enumerate(parts):
                    names.append(np.full(len(part), name))
                    trees.append(np.full(len(part), k))
                    docs.append(part)
                    if sum(map(len, docs[-64:])) > 50_000:
                        yield _members(pa, names, trees, docs)
                        names, trees, docs = [], [], []
            yield _members(pa, names, trees, docs)

    return groups.mapInArrow(run, "name long, tree long, doc_id long")


def _members(pa, *columns):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in columns], names=["name", "tree", "doc_id"]
    )


def candidates(groups: DataFrame, points: DataFrame, partners: int | None, first_round: bool) -> DataFrame:
    """(a, b, name): pairs a > b that the trees leave to verify, and without a pair the groups that kept some back.

    Rounds of several partners tell each point its least groups, so that a pair
    comes out of one group and not of each that it shares.
    """
    members = tree_members(groups, first_round)
    once = not first_round and partners != 1
    if once:
        members = members.join(members.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("name")), 1, GROUPS_TOLD).alias("names")), "doc_id")
    members = members.join(points, "doc_id")
    trees = members.repartition("name", "tree").sortWithinPartitions("name", "tree", "doc_id")

    def run(batches):
        import pyarrow as pa

        def found(table):
            table = table.combine_chunks()
            names, trees_, ids, roots, sizes = (table.column(k).to_numpy() for k in range(5))
            _, cuts, data = (vector := table.column(5).combine_chunks().cast(pa.large_binary())).buffers()
            cuts = np.frombuffer(cuts, np.int64)[vector.offset : vector.offset + len(vector) + 1]
            packed = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]
            edge = np.flatnonzero((names[1:] != names[:-1]) | (trees_[1:] != trees_[:-1])) + 1
            edge = np.concatenate([[0], edge, [len(names)]])
            all_groups = None
            if once:
                lists = table.column(6).combine_chunks()
                all_groups = lists.values.to_numpy(), lists.offsets.to_numpy()
            a, b, open_ = search(Points(ids, roots, sizes, packed, cuts - cuts[0], names, all_groups), edge, partners)
            open_ = np.unique(names[edge[open_]])
            none = pa.nulls(len(open_), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "name"])
            yield pa.RecordBatch.from_arrays([none, none, pa.array(open_)], names=["a", "b", "name"])

        for table in _whole_trees(batches):
            yield from found(table)

    columns = ["name", "tree", "doc_id", "root", "n", "vector", *(["names"] if once else [])]
    return trees.select(columns).mapInArrow(run, "a long, b long, name long").distinct()


def _whole_trees(batches):
    """Tables of consecutive rows that end where a tree (the first two columns) ends, of about the chunk size."""
    import pyarrow as pa

    held, rows, size = [], 0, 0
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            held.append(part)
            rows += part.num_rows
            size += sum(part.column(k).nbytes for k in range(5, part.num_columns))
            if rows < CHUNK_ROWS and size < CHUNK_BYTES:
                continue
            table = pa.Table.from_batches(held)
            name, tree = (table.column(k).to_numpy() for k in (0, 1))
            before = np.flatnonzero((name != name[-1]) | (tree != tree[-1]))
            if len(before):
                cut = int(before[-1]) + 1
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                rows, size = table.num_rows - cut, 0
    if rows:
        yield pa.Table.from_batches(held)


def _pairs(pa, pairs: set[tuple[int, int]]):
    ordered = sorted(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in ordered], pa.int64()) for k in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """The pairs that link, from the whole shingle sets of their documents.

    A pair meets at its smaller id; each chunk of ``HUB_CHUNK`` of its partners gets a copy of that
    text. The pairs are matched to the texts by a broadcast after a check of their number.
    """
    degree = pairs.groupBy("b").agg(F.count("*").alias("degree"))
    chunks = F.ceil(F.col("degree") / HUB_CHUNK).cast("long")
    leaves = pairs.join(degree, "b").select(F.col("a").alias("doc_id"), "b", F.pmod(F.xxhash64("a"), chunks).alias("chunk"), F.lit(True).alias("leaf"))
    hubs = degree.select(F.col("b").alias("doc_id"), "b", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), F.lit(False).alias("leaf"))
    wanted = stored(leaves.unionAll(hubs), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    met = rows.join(wanted, "doc_id").select("b", "chunk", "leaf", "doc_id", "text")
    together = met.repartition("b", "chunk").sortWithinPartitions("b", "chunk", "leaf")

    def run(batches):
        import pyarrow as pa

        current, own = None, []
        for batch in batches:
            texts = text_column(batch, "text")
            found = []
            for x, y in slices(texts):
                part = batch.slice(x, y - x)
                sets = shingle_sets(Words(texts.slice(x, y - x)), width)
                for s, b, chunk, leaf, doc in zip(sets, *(part.column(k).to_pylist() for k in range(4)), strict=True):
                    if (b, chunk) != current:
                        current, own = (b, chunk), []
                    if not leaf:
                        own.append(s)
                        continue
                    for hub in own:
                        shared = len(np.intersect1d(hub, s, assume_unique=True))
                        if 7 * shared >= 3 * (len(hub) + len(s)) and shared:
                            found.append((doc, b))
            yield _pairs(pa, set(found))

    return together.mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    spark = small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.where("doc_id is not null")
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sketches = stored(sketch(rows, width, frequent_shingles(known, width)), "sketch")
    filled = sketches.where("n > 0 and doc_id is not null")
    # Classes of equal sets; a class of one needs no row.
    classes = filled.groupBy("one", "two", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    keyed = _with_class(sketches.select("doc_id", "n", "one", "two"), stored(classes.select("one", "two", "n", "rep"), "classes"))
    member = stored(keyed.withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))), "member")
    copies = member.where("rep <> doc_id").select("doc_id", "one", "two", "n").distinct()
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    points = filled.join(copies, ["doc_id", "one", "two", "n"], "left_anti").select("doc_id", "n", "route", "vector")
    # One id with several texts is one node: its classes belong together.
    several = member.where("n > 0").groupBy("doc_id").agg(F.count_distinct("rep").alias("reps")).where("reps > 1").select("doc_id")
    several = stored(member.where("rep <> doc_id").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "several")

    roots = None if several.isEmpty() else components(several)
    tried, groups, routes = None, None, None
    for first, partners in [*((FIRST_ROUTES, k) for k in FIRST_PARTNERS), *((None, k) for k in PARTNERS)]:
        if roots is None:
            labelled = points.withColumn("root", F.col("doc_id"))
        else:
            labelled = points.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        if groups is None or routes != first:
            # Components only grow: groups that span several now are all that later rounds can need.
            groups, routes = stored(routed(labelled, first, ranges), "groups"), first
        result = stored(candidates(groups, labelled.select("doc_id", "root", "n", "vector"), partners, first is not None), "candidates")
        kept_back = result.where("a is null").select("name")
        left = kept_back.count()
        found = result.where("a is not null").select("a", "b")
        if tried is not None:
            found = stored(found.join(tried, ["a", "b"], "left_anti"), "untried")
        if not found.isEmpty():
            links = verified(found, known, width)
            tried = found if tried is None else tried.unionAll(found)
            if roots is not None:
                links = links.unionAll(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = components(links)
        if first is None:
            # The finished groups have nothing left between components.
            if not left:
                break
            kept_back = F.broadcast(kept_back) if left <= BROADCAST_IDS else kept_back
            groups = groups.join(kept_back, "name", "left_semi")
    if roots is None:
        return member.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
    roots = stored(roots.where("node <> root"), "roots")
    roots = F.broadcast(roots) if roots.count() <= BROADCAST_IDS else roots
    return member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows with the representative of their class, if any; a class's rows are salted where classes are many."""
    keys = ["one", "two", "n"]
    if classes.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(classes), keys, "left")
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows, with all their columns, of one document of each group: that with the component's id.

    Rows without an id or a shingle stay; of several rows with one id the one with the least text stays.
    """
    found = jaccard_components(docs, id_col, text_col, width)
    found = stored(found.where("doc_id is not null"), "components")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, id_col, "left_anti")
    twice = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col))
    if twice.isEmpty():
        return kept.select(docs.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    several = kept.join(twice, id_col, "left_semi").groupBy(F.col(id_col).alias("one_id"))
    once = several.agg(F.min_by(row, F.struct(F.coalesce(F.col(text_col), F.lit("")), F.to_json(row))).alias("row")).select("row.*")
    return kept.join(twice, id_col, "left_anti").unionByName(once).select(docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
