"""Near copies by SimHash fingerprints, found with vantage-point trees.

A fingerprint's bit is set where more than half of the document's shingles, repeats included, hash to a set bit.
Documents link where fingerprints differ in RADIUS bits at most. Equal fingerprints are one node from the start.

Distinct fingerprints are dealt to shards by a vantage-point tree: at each of its nodes those within a distance of a
vantage point go inside and the others outside. By the triangle inequality, of two fingerprints that link both are
within distance t, or both are at t - RADIUS + 1 or farther; so the boundary, RADIUS distances wide, goes to both
sides, and every linked pair meets in a shard whole. Trees are grown on a sample of a shard's fingerprints, which
bears on the shards' sizes alone; shards over LEAF fingerprints are split again, and a shard that no vantage point
splits is compared in blocks, all against all. Within a shard the same bounds prune the search. A shard returns one
link for each fingerprint of a local component but its first, so groups of near copies are never spelt out as pairs.

Nulls and ties: a null or blank text has no shingles and the fingerprint zero, which links like any other; fewer words
than a shingle has make one shingle. A null doc_id takes part but names no component. Rows that repeat are linked by
their equal fingerprints. Empty tables give empty results; texts of any length are used whole, a piece at a time;
columns other than doc_id and text are not read, so their names do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded, discard, map_arrow, materialize, slices
from quarry.llm.jaccard_join import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: Fingerprints of a shard, of the sample that its tree is grown on, and of a chunk that a task routes with one copy of the tree.
LEAF, SAMPLE, CHUNK = 16_384, 4096, 65_536
#: Fingerprints that are compared all against all, and vantage points that are tried at a split.
DENSE, TRIED = 512, 16
#: A split must leave each side with less than this share.
SHRINKS = 0.95

_SPACE = re.compile(rb"[ \t-\r]")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None) -> int:
    """The 64 bits as an unsigned integer."""
    data = (text or "").encode().lower()
    ones, n, before, at = np.zeros(64, np.int64), 0, [], 0

    def add(shingles: list[bytes]) -> None:
        nonlocal n
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
        ones[:] += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(shingles)

    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        words = before + data[at:end].split()
        if len(words) >= SHINGLE:
            add([b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)])
        before, at = words[max(0, len(words) - SHINGLE + 1) :], end
    if not n and before:
        add([b" ".join(before)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, print) of every row: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch):
                found = np.array([fingerprint(t.as_py()) for t in cut.column("text")], np.uint64)
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])

    docs = documents.select("doc_id", "text")
    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print long")


def _cut(points: np.ndarray, tried: np.ndarray) -> tuple[int, int] | None:
    """The vantage point and distance that split points with the least work on both sides, if both sides shrink."""
    n, best = len(points), None
    for v in tried:
        within = np.cumsum(np.bincount(np.bitwise_count(points ^ v), minlength=65))
        t = np.arange(RADIUS - 1, 65)
        inside, outside = within[t], n - np.r_[0, within][t - RADIUS + 1]
        cost = np.where(np.maximum(inside, outside) < SHRINKS * n, inside**1.4 + outside**1.4, np.inf)
        k = int(cost.argmin())
        if np.isfinite(cost[k]) and (best is None or cost[k] < best[0]):
            best = (cost[k], int(v), int(t[k]))
    return best and best[1:]


def _spread(points: np.ndarray) -> np.ndarray:
    return points[np.linspace(0, len(points) - 1, min(TRIED, len(points))).astype(int)]


def _sides(points: np.ndarray, vantage: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points go inside, and which outside; the boundary is on both sides."""
    apart = np.bitwise_count(points ^ np.uint64(vantage))
    return apart <= t, apart >= t - RADIUS + 1


def grow(sample: np.ndarray, leaf: int) -> np.ndarray | None:
    """A tree as rows (vantage, t, inside, outside), children as places of rows or, negative, of leaves; None if nothing splits."""
    rows, leaves = [], 0
    todo = [(sample, None, 0)]
    while todo:
        points, parent, side = todo.pop()
        cut = _cut(points, _spread(points)) if len(points) > leaf else None
        if cut:
            place = len(rows)
            rows.append([np.uint64(cut[0]).astype(np.int64), cut[1], 0, 0])
            todo += [(points[kept], place, k + 2) for k, kept in enumerate(_sides(points, *cut))]
        else:
            leaves += 1
            place = -leaves
        if parent is not None:
            rows[parent][side] = place
    return np.array(rows, np.int64) if rows else None


def route(tree: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, place in points): every leaf that each point goes to."""
    leaves, places, todo = [], [], [(0, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        if at < 0:
            leaves.append(np.full(len(own), at))
            places.append(own)
        elif len(own):
            vantage, t, *children = tree[at].tolist()
            todo += [(child, own[kept]) for child, kept in zip(children, _sides(points[own], vantage & (2**64 - 1), t), strict=True)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *leaves]), np.concatenate([none, *places])


def roots(points: np.ndarray) -> np.ndarray:
    """For each of these distinct points the place of its component's first, by links within them."""
    up = list(range(len(points)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def compare(own: np.ndarray) -> None:
        near = np.bitwise_count(points[own][:, None] ^ points[own]) <= RADIUS
        first, known = near.argmax(axis=1), np.arange(len(own))
        while (first != known).any():
            known, first = first, np.where(near, first, len(own)).min(axis=1)
            first = first[first]
        for k in np.flatnonzero(known != np.arange(len(own))).tolist():
            x, y = root(int(own[k])), root(int(own[known[k]]))
            up[max(x, y)] = min(x, y)

    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        cut = _cut(points[own], _spread(points[own])) if len(own) > DENSE else None
        if cut:
            todo += [own[kept] for kept in _sides(points[own], *cut)]
        elif len(own) <= DENSE:
            compare(own)
        else:  # no vantage point splits these: all against all, in blocks
            parts = np.array_split(own, -(-len(own) * 2 // DENSE))
            for i in range(len(parts)):
                for j in range(i + 1, len(parts)):
                    compare(np.r_[parts[i], parts[j]])
    return np.array([root(x) for x in range(len(points))], np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _trees(sample: DataFrame) -> DataFrame:
    """(shard, n, tree) for rows (shard, n, print) of a sample: the tree is null where nothing splits."""

    def run(group: pa.Table) -> pa.Table:
        n = group.column("n")[0].as_py()
        points = np.sort(group.column("print").to_numpy()).view(np.uint64)
        tree = grow(points[np.argsort(_mix(points))], max(16, len(points) * LEAF * 2 // (3 * n)))
        return pa.table([group.column("shard")[:1], group.column("n")[:1], pa.array([None if tree is None else tree.tobytes()], pa.binary())], names=["shard", "n", "tree"])

    return sample.groupBy("shard").applyInArrow(run, "shard long, n long, tree binary")


def _routed(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """(shard, print) after one more tree for each shard: a chunk of a shard's rows follows its tree."""
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    known = bounded(trees.select("shard", chunks.alias("chunks")))
    none = F.lit(None)
    points = rows.join(known, "shard").select("shard", F.pmod(F.xxhash64("print"), "chunks").cast("int").alias("chunk"), none.cast("binary").alias("tree"), "print")
    heads = trees.select("shard", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "tree", none.cast("long").alias("print"))
    dealt = heads.unionByName(points).repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", F.col("tree").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shard = None, np.uint64(0)
        for batch in batches:
            is_head = batch.column("tree").is_valid().to_numpy(zero_copy_only=False)
            cuts = sorted({0, *np.flatnonzero(is_head).tolist(), batch.num_rows})
            for start, end in zip(cuts, cuts[1:], strict=False):
                if is_head[start]:
                    tree = np.frombuffer(batch.column("tree")[start].as_py(), np.int64).reshape(-1, 4)
                    shard = np.uint64(batch.column("shard")[start].as_py() & (2**64 - 1))
                    start += 1
                if end > start:
                    points = batch.column("print").slice(start, end - start).to_numpy(zero_copy_only=False).astype(np.int64)
                    leaf, place = route(tree, points.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(_mix(leaf.view(np.uint64) * _STEP + shard).view(np.int64)), pa.array(points[place])], ["shard", "print"])

    return map_arrow(dealt, run, "shard long, print long")


def shards(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(shard, blocks, print) for distinct fingerprints (print), and the tables written for it.

    All pairs that link are together in some shard; blocks is over 1 where a large shard could not be split.
    """
    rows, done, kept = materialize(nodes.select(F.lit(0).cast("long").alias("shard"), "print"), "simhash-shards"), [], []
    while True:
        kept.append(rows)
        sizes = materialize(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > LEAF), "simhash-sizes")
        kept.append(sizes)
        large = bounded(sizes)
        done.append(rows.join(large, "shard", "left_anti").select("shard", F.lit(1).alias("blocks"), "print"))
        if sizes.isEmpty():
            break
        sample = rows.join(large, "shard").where(F.pmod(F.xxhash64("print"), F.ceil(F.col("n") / SAMPLE)) == 0)
        trees = materialize(_trees(sample.select("shard", "n", "print")), "simhash-trees")
        kept.append(trees)
        whole = bounded(trees.where("tree is null").select("shard", F.ceil(F.col("n") / LEAF).cast("int").alias("blocks")))
        done.append(rows.join(whole, "shard").select("shard", "blocks", "print"))
        rows = materialize(_routed(rows, trees.where("tree is not null")), "simhash-shards")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every, kept


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) for distinct fingerprints (print): links that have the components of all pairs within RADIUS bits."""
    dealt, kept = shards(nodes)
    block = F.pmod(F.xxhash64("print", F.lit(1)), "blocks").cast("int")
    pairs = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def run(group: pa.Table) -> pa.Table:
        points = np.sort(group.column("print").to_numpy()).view(np.uint64)
        first = roots(points)
        linked = np.flatnonzero(first != np.arange(len(points)))
        return pa.table([pa.array(points[linked].view(np.int64)), pa.array(points[first[linked]].view(np.int64))], names=["a", "b"])

    both = pairs.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "print")
    found = materialize(both.groupBy("shard", "i", "j").applyInArrow(run, "a long, b long"), "simhash-links")
    discard(*kept)
    return found


def near_copies(documents: DataFrame) -> DataFrame:
    """(doc_id, print, component_id) of every row: the fingerprint, and the least doc_id reachable by links."""
    prints = materialize(fingerprints(documents), "simhash-prints")
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = links(nodes)
    labels = components(found)
    told = nodes.join(bounded(labels), F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("label", "print").alias("label"))
    told = materialize(told, "simhash-labels")
    first = told.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialize(told.join(first, "label").select("print", "component_id"), "simhash-components")
    discard(found, nodes, told)
    return prints.join(bounded(named), "print").select("doc_id", "print", "component_id")
