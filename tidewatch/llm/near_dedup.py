"""MinHash near-dedup: many universal hash minima with banding, signature verification, confirmation on the full sets
and connected components by alternating large-star and small-star.

A document's set holds the 64-bit hashes of its distinct `width`-word shingles (A-Z in lower case); with fewer words the
whole sequence is one shingle; without words the set is empty and linked with nothing. Two documents are linked when
their Jaccard similarity is at least `percent` per cent.

How pairs are found without ever making all pairs of a group:

1. Documents with the same set (equal size and 128-bit set hash) become one node, the smallest id.
2. Nodes meet in band buckets. In each bucket all members are compared with one leader only: pairs grow as the rows do.
   Pairs that pass the signature estimate are confirmed on the full sets; links give parts.
3. A bucket is settled once its members are all in one part. Members of other buckets are mostly texts that share a
   passage. Their shingles are put in one order: those that a single part holds first, then by the number of members that
   hold them. Two sets that are similar enough share a shingle among the first of either (a prefix of about a fifth), so
   nodes meet again by the shingles of their prefixes that several parts hold. A shared passage is far behind in that order.
4. There too, members are first compared with one leader per shingle, the same for as many shingles as can be; shingles
   whose members are all in one part are settled. With more `turns`, where the rest would still be many rows in blocks, as in a
   large group of texts about as similar as the threshold, other leaders follow, turn by turn, as long as a turn links a
   twentieth of what is open: each leader links a share of its group, so few turns leave little of it. A turn is some dozens of
   short jobs, so it pays where a group has many thousands of such members. What is left is clustered by shared shingles. A cluster, or each of its
   shingles where that sends fewer sets, is dealt into blocks of bounded size, and the members of two blocks are compared
   on their full sets inside a task, which returns links only: no row per pair is made.

Null text has no words. Rows without id are linked with nothing: component_id is null and they are kept. A document is
an id: rows that repeat an id share its links. Extra columns are ignored. Ties and empty tables need no special case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .hashing import STEP, mix, range_hashes, text_chunks

BANDS, ROWS = 32, 5

_rng = np.random.default_rng(20240301)
_PLACE = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every word of the concatenated texts; a text's first byte begins a word anew."""
    n = len(data)
    data = _LOWER[data]
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[begins[begins < n]] = True
    first[n] = True
    before = np.concatenate(([False], solid[:-1])) & ~first[:-1]
    after = np.concatenate((solid[1:], [False])) & ~first[1:]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return range_hashes(data, starts, ends), np.searchsorted(begins, starts, "right") - 1


def shingle_sets(data: np.ndarray, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and the size of each text's set."""
    words, doc = _word_hashes(data, begins)
    count = np.bincount(doc, minlength=len(begins))
    at = np.concatenate(([0], np.cumsum(count)))
    m = len(words) - width + 1
    parts, owners = [], []
    if m > 0:
        inside = doc[:m] == doc[width - 1 :]
        total = np.full(m, np.uint64(width))
        for j in range(width):
            total += words[j : j + m] * _PLACE[j]
        parts.append(mix(total)[inside])
        owners.append(doc[:m][inside])
    for k in range(1, width):
        short = np.flatnonzero(count == k)
        if len(short):
            total = np.full(len(short), np.uint64(k))
            for j in range(k):
                total += words[at[short] + j] * _PLACE[j]
            parts.append(mix(total))
            owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
    owner, hashes = np.concatenate(owners), np.concatenate(parts)
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    edges = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(begins)))))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(begins))


def signatures(width: int):
    """mapInArrow function: doc_id, n_shingles, two halves of the set's hash, the minima as bytes (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, begins in text_chunks(batch):
                hashes, sizes = shingle_sets(data, begins, width)
                full = np.flatnonzero(sizes)
                s1, s2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                minima: list[bytes | None] = [None] * len(sizes)
                if len(full):
                    at = np.concatenate(([0], np.cumsum(sizes[full])))[:-1]
                    s1[full] = np.add.reduceat(hashes, at)
                    s2[full] = np.add.reduceat(mix(hashes ^ STEP), at)
                    sig = np.empty((len(_MUL), len(full)), np.uint32)
                    for p in range(len(_MUL)):
                        sig[p] = np.minimum.reduceat((hashes * _MUL[p] + _ADD[p]) >> np.uint64(32), at)
                    for i, r in zip(full.tolist(), np.ascontiguousarray(sig.T)):
                        minima[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), pa.array(sizes.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(minima, pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "sig"],
                )

    return run


def full_sets(width: int):
    """mapInArrow function: doc_id and its sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, begins in text_chunks(batch):
                hashes, sizes = shingle_sets(data, begins, width)
                at = np.concatenate(([0], np.cumsum(sizes)))
                sets = [hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(sets, pa.binary())], names=["doc_id", "items"])

    return run


def _estimated(percent: int, slack: float = 0.19):
    """mapInArrow function: of pairs with both signatures those whose estimate is not `slack` (about six deviations) below the threshold."""
    least = (percent / 100 - slack) * len(_MUL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, len(_MUL)) for c in ("sig_a", "sig_b"))
            good = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return run


def _confirmed(percent: int):
    """mapInArrow function: of pairs with both full sets those with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge table (a, b); the component is its smallest node.

    Alternating large-star and small-star: every round is two grouped minima and joins on the node. All edges of a node
    are never gathered: the minima of a round are partial aggregates and a table of their own, so the join of a hot node's
    edges with its minimum is one that Spark can split. Nodes in no edge are not returned.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(after, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components of known parts (node, component) and further links."""
    return parts if links.isEmpty() else connected_components(parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


class _Confirmer:
    """Confirms candidate pairs; keeps the full sets of the nodes seen so far, so that no text is read twice for them."""

    #: Up to so many ids (16 bytes each) are broadcast to the scan of the texts; more are joined by a shuffle.
    FEW = 100_000

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.texts = docs.select("doc_id", "text")
        self.nodes, self.width, self.percent = nodes, width, percent
        self.sets: DataFrame | None = None

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """(doc_id, items) of at least these ids (__id); texts are read for those not seen before."""
        if self.sets is not None:
            ids = ids.join(self.sets.select(F.col("doc_id").alias("__id")), "__id", "left_anti")
        ids = written(ids, "to-read")
        few = ids.count()
        if few or self.sets is None:
            side = F.broadcast(ids) if few <= self.FEW else ids.hint("shuffle_hash")
            wanted = self.texts.join(side, self.texts["doc_id"] == ids["__id"], "left_semi" if few <= self.FEW else "inner").select("doc_id", "text")
            more = written(wanted.mapInArrow(full_sets(self.width), "doc_id long, items binary"), "sets")
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        return self.sets

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) among distinct candidate pairs (a, b)."""
        sig = self.nodes.select("doc_id", "sig", "n_shingles")
        left = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a")), "a")
        both = left.join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b")), "b")
        sized = both.where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        likely = written(sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_estimated(self.percent), "a long, b long").distinct(), "likely")
        sets = self.sets_of(likely.select(F.col("a").alias("__id")).unionByName(likely.select(F.col("b").alias("__id"))).distinct())
        x = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a")
        y = x.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b")
        return written(y.select("a", "b", "items_a", "items_b").mapInArrow(_confirmed(self.percent), "a long, b long").distinct(), "links")


def _pair(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _exploded_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: one row per shingle of doc_id, part, n, items."""
    for batch in batches:
        for row in range(0, batch.num_rows, 64):
            piece = batch.slice(row, 64)
            sets = [np.frombuffer(x, np.int64) for x in piece.column("items").to_pylist()]
            sizes = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(piece.column(c).to_numpy(zero_copy_only=False), sizes), pa.int64()) for c in ("doc_id", "part", "n")] + [pa.array(np.concatenate(sets))], names=["doc_id", "part", "n", "h"]
            )


def _prefixes(members: DataFrame, percent: int) -> DataFrame:
    """(h, doc_id, part): of members (doc_id, part, n, items) the shingles of their prefixes that several parts hold.

    A set of n may leave out n - ceil(percent * n / 100) shingles of its partner's and still be linked, so one of its first
    n - ceil(percent * n / 100) + 1 is shared; shingles of one part only come first in the order and are never shared.
    """
    rows = members.select("doc_id", "part", "n", "items").mapInArrow(_exploded_sets, "doc_id long, part long, n long, h long")
    spread = rows.groupBy("h").agg(F.count("*").alias("f"), F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 <> p1").select("h", "f")
    shared = rows.join(spread, "h")
    own = Window.partitionBy("doc_id")
    least = F.ceil(F.col("n") * percent / 100)
    ranked = shared.withColumn("c", F.count("*").over(own)).where(F.col("c") >= least).withColumn("r", F.row_number().over(own.orderBy("f", "h")))
    return ranked.where(F.col("r") <= F.col("c") - least + 1).select("h", "doc_id", "part")


def _unsettled(rows: DataFrame, key: str) -> DataFrame:
    """Of rows (key, doc_id, part) those whose key several parts hold."""
    open_ = rows.groupBy(key).agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 <> p1").select(key)
    return rows.join(open_, key)


#: How many times the open rows blocks may send before another turn of leaders is tried.
MANY = 4
#: Members and shingles of a block, about; two blocks are in memory at a time.
BLOCK, BLOCK_ITEMS = 192, 150_000


def _linked_blocks(percent: int):
    """applyInArrow function over two blocks of a unit (side 0, side 1; one block alone has i = j): links between parts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, part, side = (table.column(c).to_numpy() for c in ("doc_id", "part", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        order = np.lexsort((ids, side))
        n = np.array([len(s) for s in sets], np.int64)
        alone = key[2].as_py() == key[3].as_py()
        left = [k for k in order if side[k] == 0]
        right = left if alone else [k for k in order if side[k] == 1]
        links: list[tuple[int, int]] = []
        if left and right:
            # Shared shingles are numbered; the intersections of all pairs are a product of 0/1 matrices, some columns at a time.
            every = np.concatenate([sets[k] for k in order])
            owner = np.repeat(np.arange(len(order)), n[order])
            _, number, times = np.unique(every, return_inverse=True, return_counts=True)
            useful = times[number] > 1
            number, owner = number[useful], owner[useful]
            rank = np.cumsum(times > 1) - 1
            number = rank[number]
            place = {k: x for x, k in enumerate(order)}
            x, y = np.array([place[k] for k in left]), np.array([place[k] for k in right])
            both = np.zeros((len(x), len(y)), np.float32)
            by = np.argsort(number, kind="stable")
            number, owner = number[by], owner[by]
            width = 4096
            for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
                lo, hi = np.searchsorted(number, (a, a + width))
                m = np.zeros((len(order), width), np.float32)
                m[owner[lo:hi], number[lo:hi] - a] = 1
                both += m[x] @ m[y].T
            shared = both.astype(np.int64)
            nx, ny = n[left], n[right]
            good = 100 * shared >= percent * (nx[:, None] + ny[None, :] - shared)
            good &= part[left][:, None] != part[right][None, :]
            links = [(min(ids[left[i]], ids[right[j]]), max(ids[left[i]], ids[right[j]])) for i, j in np.argwhere(good)]
        links = sorted(set(links))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _units(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How rows (h, doc_id, part, cluster, n) are compared: (cluster, unit, doc_id, part) and (cluster, unit, blocks).

    A cluster is one unit, or each of its shingles is one (shingles with the same members count once), whichever sends
    fewer sets. All pairs that share a shingle meet either way: close groups go as a whole, long chains of small groups
    by shingle, so that the rows of a chain grow as its length does.
    """
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("items_") / BLOCK_ITEMS)).cast("int")
    size = [F.count("*").alias("m"), F.sum("n").alias("items_")]
    whole = met.select("cluster", F.col("cluster").alias("unit"), "doc_id", "part", "n").distinct()
    marks = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
    single = met.groupBy("cluster", "h").agg(*size, *marks).groupBy("cluster", "m", "items_", "mark0", "mark1").agg(F.min("h").alias("unit"))
    units = whole.groupBy("cluster", "unit").agg(*size).select("cluster", "unit", "m", blocks.alias("blocks"), F.lit(True).alias("whole"))
    units = written(units.unionByName(single.select("cluster", "unit", "m", blocks.alias("blocks"), F.lit(False).alias("whole"))), "units")
    rows = F.col("m") * F.col("blocks")
    cost = units.groupBy("cluster").agg(F.sum(F.when(F.col("whole"), rows)).alias("as_one"), F.sum(F.when(~F.col("whole"), rows)).alias("by_shingle"))
    chosen = written(units.join(cost, "cluster").where(F.col("whole") == (F.col("as_one") <= F.col("by_shingle"))).select("cluster", "unit", "blocks", "whole"), "units")
    of_cluster = whole.select("cluster", "unit", "doc_id", "part").join(chosen.where("whole").select("cluster", "unit"), ["cluster", "unit"], "left_semi")
    of_shingle = met.select("cluster", F.col("h").alias("unit"), "doc_id", "part").join(chosen.where("not whole").select("cluster", "unit"), ["cluster", "unit"], "left_semi")
    return of_cluster.unionByName(of_shingle), chosen.select("cluster", "unit", "blocks")


def _many_rows(met: DataFrame) -> bool:
    """Whether comparing what is open in blocks, shingle by shingle, would send many times the rows that there are."""
    marks = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
    units = met.groupBy("h").agg(F.count("*").alias("m"), *marks).select("m", "mark0", "mark1").distinct()
    rows, sent = units.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.col("m") * F.ceil(F.col("m") / BLOCK)), F.lit(0))).first()
    return sent > MANY * rows


def _marked(rows: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """rows (key, doc_id) with the part of each node."""
    return rows.select(key, "doc_id").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(key, "doc_id", F.coalesce("component", "doc_id").alias("part"))


def _parts_by_shingles(rest: DataFrame, parts: DataFrame, confirm: _Confirmer, turns: int) -> DataFrame:
    """The parts, joined by the links between nodes of different parts that are in an unsettled bucket. rest: bucket, doc_id, part."""
    nodes, percent = confirm.nodes, confirm.percent
    sets = confirm.sets_of(rest.select(F.col("doc_id").alias("__id")).distinct())
    members = rest.select("doc_id", "part").distinct().join(nodes.select("doc_id", F.col("n_shingles").alias("n")), "doc_id").join(sets, "doc_id")
    met = written(_unsettled(_prefixes(members, percent), "h"), "prefixes")
    if met.isEmpty():
        return parts
    for turn in range(turns):
        # The same order of leaders for all shingles, so that nodes which share many meet one leader; another order each turn.
        order = F.xxhash64("doc_id", *([F.lit(turn)] if turn else []))
        heads = met.groupBy("h").agg(F.min(F.struct(order.alias("o"), "doc_id", "part")).alias("head")).select("h", F.col("head.doc_id").alias("leader"), F.col("head.part").alias("lead"))
        links = confirm(met.join(heads, "h").where("part <> lead").select(*_pair("leader", "doc_id")).distinct())
        if turns > 1:
            links = written(links, "leader-links")
        open_ = met.select("part").distinct().count() if turn else 0
        parts = _joined(parts, links)
        met = written(_unsettled(_marked(met, "h", parts), "h"), "prefixes")
        if met.isEmpty():
            return parts
        if turn + 1 == turns or not _many_rows(met) or (turn and 20 * links.count() < open_):
            break
    near = met.join(met.groupBy("h").agg(F.min("doc_id").alias("head")), "h").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
    clusters = connected_components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    met = written(met.join(clusters, "doc_id").join(nodes.select("doc_id", F.col("n_shingles").alias("n")), "doc_id"), "clusters")
    members, units = _units(met)
    dealt = members.join(units, ["cluster", "unit"]).join(sets, "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select("cluster", "unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "doc_id", "part", "items")
    return _joined(parts, written(keyed.groupBy("cluster", "unit", "i", "j").applyInArrow(_linked_blocks(percent), "a long, b long").distinct(), "links"))


def near_classes(docs: DataFrame, width: int = 5, percent: int = 80, turns: int = 1) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links, itself included), kept.

    turns: of leaders at most; the classes are the same with any number, only what is left for blocks differs.
    """
    light = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(signatures(width), "doc_id long, n_shingles long, s1 long, s2 long, sig binary"), "signatures")
    per_set = written(light.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("node")), "set-classes")
    own = per_set.select(F.col("node").alias("doc_id"), "s1", "s2")
    nodes = written(light.join(own, ["doc_id", "s1", "s2"], "left_semi").select("doc_id", "n_shingles", "sig"), "nodes")

    band = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)]))
    rows = nodes.select("doc_id", band.alias("bucket"))
    met = rows.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader <> last")
    rows = written(rows.join(met.select("bucket", "leader"), "bucket"), "buckets")

    confirm = _Confirmer(docs, nodes, width, percent)
    links = confirm(rows.where("doc_id <> leader").select(*_pair("leader", "doc_id")).distinct())
    parts = connected_components(links)
    rest = written(_unsettled(_marked(rows, "bucket", parts), "bucket"), "unsettled")
    if not rest.isEmpty():
        parts = _parts_by_shingles(rest, parts, confirm, turns)

    named = light.select("doc_id", "n_shingles", "s1", "s2").join(per_set, ["s1", "s2", "n_shingles"], "left")
    joined = named.join(parts, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are their class's smallest id (and rows without id), all columns."""
    kept = near_classes(docs.select("doc_id", "text"), width, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("__keep")).distinct()
    with_id = docs.join(kept.hint("shuffle_hash"), docs["doc_id"] == kept["__keep"], "left_semi")
    return with_id.unionByName(docs.where("doc_id is null"))
