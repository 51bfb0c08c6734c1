"""Join of documents by Jaccard similarity of word shingles, by parity sketches.

A parity sketch of a set has one bit for each bucket of a hash: the parity of how many members fall there. Two
sketches differ in no more bits than the sets' symmetric difference has members, and sets of similarity 0.75 differ in
at most (|A| + |B|) / 7 members. So for each band of sizes the hash range is cut into parts, more than the members
that may differ; by the pigeonhole principle similar sets have parts that agree, and the XOR of the hashes of a part's
members, with the part's number, is a key that both documents send. Each sends its least keys, a tenth of its size
more than may differ, so similar sets meet under many keys. Documents that meet often enough are candidates; the
Hamming distance of their sketches discards those that are too far apart, and what is left is compared by members.

Nothing is capped. Equal sets are one node from the start. Of documents that meet often, the one with most shared keys
becomes a centre to which the others are compared first; then only documents that are not yet in one component are
compared. Each document leaves some of its largest meetings, half as many as it shares for certain with any similar
one. Of the small meetings that remain, pairs are counted, and those that meet less often than similar sets must are
dropped before anything else is fetched; large ones are compared in blocks of bounded size, nearest sketches first.

The bound counts on a set having at least as many parts with members as it is to send. Part sizes are chosen so that
this holds but for a chance of some tenths of a per cent, and a set that falls short counts on as many meetings less;
a link can be missed only if in addition a pair stands at the very threshold with each difference in another part.

Nulls and ties: a null or blank text has no shingles and is linked with nothing; fewer words than a shingle has make
one shingle. A null doc_id takes part but names no component. Rows that repeat a doc_id or a text are linked by their
equal sets. Empty tables give empty results; texts of any length are used whole; columns other than doc_id and text
are not read. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import apart, bounded, discard, map_arrow, materialize, slices

SHINGLE = 5
#: Similarity of at least 75 / 100. The bound on differing members, (|A| + |B|) / 7, follows from it.
SHARE = (75, 100)
#: Mean members of a part at a band's upper end, and how many more keys than may differ are sent (a share of the set).
MEMBERS, SLACK = 1.8, 10
#: Meetings of up to so many documents are paired at once; larger ones are compared in blocks.
SMALL, BLOCK = 64, 2048
#: Of the sketches of a large meeting that are near enough, so many for each document and component are compared at first.
NEAREST = 4
#: A text is sent once for so many texts that it is compared with.
PARTNERS = 256
#: Bytes of text whose shingles are taken at a time, and texts that a task remembers to have seen.
SLICE, SEEN = 1 << 20, 250_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, SHINGLE)
    value = own[: n - size + 1].copy()
    for k in range(1, size):
        value = value * _STEP + own[k : n - size + 1 + k]
    return np.unique(_mix(value + np.uint64(size)))


def _level(n: int) -> int:
    """Band of a size: sizes of 4 ** (level + 2) up to 4 times that; all smaller ones are in band 0."""
    return max(0, (n.bit_length() - 1) // 2 - 2)


def _parts(level: int) -> int:
    return 512 if level == 0 else int(4 ** (level + 3) / MEMBERS)


def keys(members: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys under which a set meets all that are similar to it, and how many more there are of each band than may differ."""
    n = len(members)
    if n < 3:  # only an equal set is similar
        return np.zeros(0, np.uint64), 0
    level, out, spare = _level(n), [], n // SLACK
    mixed = _mix(members ^ np.uint64(0xD6E8FEB86659FD93))
    for at in range(level, _level(n * SHARE[1] // SHARE[0]) + 1):
        part = (members >> np.uint64(32)) * np.uint64(_parts(at)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        found = _mix(np.bitwise_xor.reduceat(mixed, first) ^ _mix(part[first] + np.uint64(at << 48)))
        most = n // 3 + 1 + n // SLACK
        spare = max(0, min(spare, len(found) - n // 3 - 1))
        out.append(found if len(found) <= most else np.partition(found, most)[:most])
    return np.concatenate(out), spare


def _spared(n: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """How many of its largest meetings a set of that size leaves: half of what the smallest similar set counts on."""
    return np.minimum(spare, n * SHARE[0] // SHARE[1] // SLACK) // 2


def _needed(n_a: np.ndarray, spare_a: np.ndarray, n_b: np.ndarray, spare_b: np.ndarray) -> np.ndarray:
    """How many of the meetings that are left two sets share at least if they are similar."""
    return np.maximum(1, 1 + np.minimum(spare_a, spare_b) - np.maximum(_spared(n_a, spare_a), _spared(n_b, spare_b)))


def _sizes_fit(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return np.minimum(n_a, n_b) * SHARE[1] >= np.maximum(n_a, n_b) * SHARE[0]


def sketch(members: np.ndarray) -> bytes:
    """Parity sketch of eight to sixteen bits for each member, by the members' low bits: few differences fall together."""
    bits = max(512, 1 << (8 * len(members) - 1).bit_length())
    count = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(count & 1).tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A wider sketch as a narrower one: parities of the parts that fall together."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _node(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)


def describe(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, n): node is a hash of the set, null for an empty one; n its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, size=SLICE):
                sets = [shingles(t) for t in cut.column("text").to_pylist()]
                nodes = [_node(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("text_hash"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "text_hash", "node", "n"])

    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, node long, n long")


def _keyed(documents: DataFrame) -> DataFrame:
    """(key, node, n, spare): each set of a task once, so copies of one text do not crowd a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for cut in slices(batch, size=SLICE):
                found, rows = [], []
                for text in cut.column("text").to_pylist():
                    members = shingles(text)
                    node = _node(members)
                    if len(members) > 2 and node not in seen:
                        if len(seen) < SEEN:
                            seen.add(node)
                        own, spare = keys(members)
                        found.append(own)
                        rows.append((node, len(members), spare))
                if found:
                    node, n, spare = (np.repeat(np.array(c, np.int64), [len(f) for f in found]) for c in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(node), pa.array(n.astype(np.int32)), pa.array(spare.astype(np.int32))], ["key", "node", "n", "spare"])

    return map_arrow(documents.select("text"), run, "key long, node long, n int, spare int")


def meetings(documents: DataFrame) -> DataFrame:
    """(meeting, node, n, spare): the nodes under each key that several have; keys are replaced by numbers in runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row of a batch waits for the next row, which tells whether it is alone
        number, waits, met = TaskContext.get().partitionId() << 40, None, False

        def rows(numbers: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(numbers), *map(pa.array, columns)], ["meeting", "node", "n", "spare"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if waits:
                columns = [np.append(w, c).astype(c.dtype) for w, c in zip(waits, columns, strict=True)]
            key, node = columns[:2]
            if not len(key):
                continue
            fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, *rest = (c[fresh] for c in columns)
            same = key[1:] == key[:-1]
            before, numbers = np.r_[met, same], number + np.r_[0, np.cumsum(~same)]
            kept = np.flatnonzero(before[:-1] | same)
            yield rows(numbers[kept], *(c[kept] for c in rest))
            waits, met, number = [c[-1] for c in (key, *rest)], bool(before[-1]), int(numbers[-1])
        if met:
            yield rows(np.array([number]), *(np.array([w]) for w in waits[1:]))

    return map_arrow(_keyed(documents).repartition("key").sortWithinPartitions("key", "node"), run, "meeting long, node long, n int, spare int")


def owed(met: DataFrame) -> DataFrame:
    """The rows of met (written already) without those large meetings that each node can spare, the largest first.

    In one order of all meetings, those that two similar sets share and either leaves are the first of the shared ones,
    and no more than the greater of what the two spare.
    """
    large = materialize(met.groupBy("meeting").agg(F.count("*").alias("size")).where(F.col("size") > SMALL), "jaccard-large")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("size"), "meeting"))
    spared = F.floor(F.least(F.col("spare"), F.floor(F.floor(F.col("n") * SHARE[0] / SHARE[1]) / SLACK)) / 2)
    ranked = met.join(bounded(large), "meeting", "left").withColumn("place", place)
    return ranked.where(F.col("size").isNull() | (F.col("place") > spared)).select(*met.columns)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by columns, and where runs of equal rows begin in it."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(fresh)


def _centres(met: DataFrame) -> DataFrame:
    """(a, b): each node with the centre it meets most often, if often enough; a meeting's centre is its node with most meetings."""
    often = materialize(met.groupBy("node").agg(F.count("*").alias("often")), "jaccard-often")
    ordered = met.join(bounded(often), "node").repartition("meeting").sortWithinPartitions("meeting", F.desc("often"), "node").select("meeting", "node", "n", "spare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = -1, [-1, 0, 0]
        for batch in batches:
            meeting, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(meeting):
                continue
            fresh = np.r_[meeting[0] != last, meeting[1:] != meeting[:-1]]
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(meeting)), -1))
            own = [np.where(at >= 0, c[at], k) for c, k in zip(columns, centre, strict=True)]
            last, centre = int(meeting[-1]), [int(c[-1]) for c in own]
            node, n, spare = (c[~fresh].astype(np.int64) for c in columns)
            own, own_n, own_spare = (c[~fresh].astype(np.int64) for c in own)
            fit = _sizes_fit(n, own_n)
            a, b, need = node[fit], own[fit], _needed(n, spare, own_n, own_spare)[fit]
            order, first = _runs(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[order][first]), pa.array(b[order][first]), pa.array(need[order][first]), pa.array(np.diff(np.r_[first, len(a)]))], ["a", "b", "need", "times"])

    pairs = map_arrow(ordered, run, "a long, b long, need long, times long").groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("need").alias("need"))
    best = pairs.groupBy("a").agg(F.max_by(F.struct("b", "need", "times"), F.struct("times", "b")).alias("best"))
    # a node may meet another one elsewhere too, so half of what is needed is enough here
    return best.where(F.col("best.times") * 2 >= F.col("best.need")).select("a", F.col("best.b").alias("b"))


def _texts(nodes: DataFrame, wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes (node), in as many copies as documents has."""
    own = materialize(nodes.select("node", F.col("text_hash").alias("_hash")).join(bounded(wanted), "node", "left_semi"), "jaccard-hashes")
    return documents.where("text is not null").select("text").join(bounded(own), F.xxhash64("text") == F.col("_hash")).select("node", "text")


def _similar(pairs: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(a, b) of the pairs (written already) whose sets are similar: by sketches, then by their members.

    Of either end the text with fewer partners is sent to the other; that one goes once to every PARTNERS pairs.
    """
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
    degree = materialize(ends.groupBy("node").agg(F.count("*").alias("degree")), "jaccard-degrees")
    rows = materialize(_texts(nodes, degree.select("node"), documents).dropDuplicates(["node"]), "jaccard-texts")
    of = bounded(degree)
    told = pairs.join(of.toDF("a", "d_a"), "a").join(of.toDF("b", "d_b"), "b")
    swap = F.col("d_a") > F.col("d_b")
    told = told.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.ceil(F.greatest("d_a", "d_b") / PARTNERS).alias("chunks"))
    probes = told.join(rows.select(F.col("node").alias("a"), "text"), "a").select("b", F.pmod(F.xxhash64("a"), "chunks").cast("int").alias("chunk"), "a", "text")
    heads = told.select("b", "chunks").distinct().join(rows.select(F.col("node").alias("b"), "text"), "b")
    heads = heads.select("b", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("chunk"), F.lit(None).cast("long").alias("a"), "text")
    dealt = heads.unionByName(probes).repartition("b", "chunk").sortWithinPartitions("b", "chunk", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = bits = shingles(None)
        for batch in batches:
            fit = []
            for a, text in zip(batch.column("a").to_pylist(), batch.column("text"), strict=True):
                own = shingles(text.as_py())
                mine = np.frombuffer(sketch(own), np.uint8)
                if a is None:
                    kept, bits = own, mine
                size, near = min(len(mine), len(bits)), False
                if a is not None and np.bitwise_count(_fold(mine, size) ^ _fold(bits, size)).sum() <= (len(own) + len(kept)) // 7:
                    common = len(np.intersect1d(own, kept, assume_unique=True))
                    near = SHARE[1] * common >= SHARE[0] * (len(own) + len(kept) - common)
                fit.append(near)
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    return map_arrow(dealt.select("b", "a", "text"), run, "a long, b long")


def _sketches(nodes: DataFrame, wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, n, sketch) of the wanted nodes (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for cut in slices(batch, size=SLICE):
                rows = []
                for node, text in zip(cut.column("node").to_pylist(), cut.column("text").to_pylist(), strict=True):
                    if node not in seen:
                        if len(seen) < SEEN:
                            seen.add(node)
                        members = shingles(text)
                        rows.append((node, len(members), sketch(members)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["node", "n", "sketch"])

    return map_arrow(_texts(nodes, wanted, documents), run, "node long, n long, sketch binary").dropDuplicates(["node"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): equal labels for one component.

    Each round every node hooks on to the first of itself and its neighbours, those with most neighbours first, and
    the links between what hooks on to different nodes remain. Ties are broken by an order that is drawn anew, so the
    graph shrinks by a constant factor, and stars vanish at once.
    """
    labels, turn = None, 0
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while labels is None or not links.isEmpty():
        ends = links.union(links.select("b", "a")).toDF("u", "v")
        degree = materialize(ends.groupBy("u").agg(F.count("*").alias("d")), "degrees")
        rank = lambda c, d: F.struct(F.col(d).alias("d"), F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("k"))  # noqa: B023, E731
        of = bounded(degree)
        best = ends.join(of.toDF("v", "dv"), "v").groupBy("u").agg(F.max(rank("v", "dv")).alias("best"))
        hooks = materialize(best.join(of.toDF("u", "du"), "u").select("u", F.greatest("best", rank("u", "du"))["k"].alias("to")), "hooks")
        near = bounded(hooks)
        if labels is None:
            labels = hooks.toDF("node", "label")
        else:
            labels = materialize(labels.join(near, F.col("label") == F.col("u"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        for end in ("a", "b"):
            links = links.join(near.toDF(end, f"to_{end}"), end)
        links = materialize(links.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), "links")
        turn += 1
    return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: only the components that these touch are looked at again."""
    of = bounded(labels)
    for end in ("a", "b"):
        links = links.join(of.toDF("_node", "_label"), F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_label", end)).drop("_node", "_label")
    fresh = components(links)
    told = labels.join(bounded(fresh).toDF("_node", "_to"), F.col("label") == F.col("_node"), "left").select("node", F.coalesce("_to", "label").alias("label"))
    new = fresh.join(of.select("node"), "node", "left_anti")
    return materialize(told.unionByName(new), "labels")


def _apart(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Of small meetings the pairs (a, b, need, times) in different components; of large ones the rows (a, meeting)."""
    told = met.join(bounded(labels), "node", "left").select("meeting", "node", F.coalesce("label", "node").alias("label"), F.col("n").cast("long"), F.col("spare").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        kept, large = (none,) * 5, None  # rows of a meeting that may go on; the large meeting that goes on

        def rows(columns: list[np.ndarray], big: np.ndarray) -> pa.RecordBatch:
            m, x, y, n, spare = (c[~big] for c in columns)
            found = [(none, none, none)]
            for step in range(1, len(m)):
                same = m[step:] == m[:-step]
                if not same.any():
                    break
                at = np.flatnonzero(same & (y[step:] != y[:-step]) & _sizes_fit(n[step:], n[:-step]))
                found.append((np.minimum(x[at], x[at + step]), np.maximum(x[at], x[at + step]), _needed(n[at], spare[at], n[at + step], spare[at + step])))
            low, high, need = (np.concatenate(c) for c in zip(*found, strict=True))
            order, first = _runs(low, high)
            low, high, need, times = low[order][first], high[order][first], need[order][first], np.diff(np.r_[first, len(order)])
            meeting, node, empty = columns[0][big], columns[1][big], np.zeros(int(big.sum()), np.int64)
            missing = np.r_[np.ones(len(low), bool), empty.astype(bool)]
            return pa.RecordBatch.from_arrays([pa.array(np.r_[low, node]), pa.array(np.r_[high, node]), pa.array(np.r_[need, empty]), pa.array(np.r_[times, empty]), pa.array(np.r_[low, meeting], mask=missing)], ["a", "b", "need", "times", "meeting"])

        for batch in batches:
            columns = [np.r_[k, c.to_numpy(zero_copy_only=False)] for k, c in zip(kept, batch.columns, strict=True)]
            meeting = columns[0]
            if not len(meeting):
                continue
            first = np.flatnonzero(np.r_[True, meeting[1:] != meeting[:-1]])
            size = np.diff(np.r_[first, len(meeting)])
            big = np.repeat((size > SMALL) | (meeting[first] == large), size)
            end = len(meeting) if big[-1] else int(first[-1])
            large = int(meeting[-1]) if big[-1] else None
            kept = [c[end:] for c in columns]
            yield rows([c[:end] for c in columns], big[:end])
        if len(kept[0]):
            yield rows(list(kept), np.zeros(len(kept[0]), bool))

    return map_arrow(told.repartition("meeting").sortWithinPartitions("meeting", "node"), run, "a long, b long, need long, times long, meeting long")


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(meeting, node, label, block, blocks): the rows of meetings of several components, dealt to blocks of BLOCK on average.

    Sizes and components of a meeting are summed before the shuffle, and blocks are drawn by a hash of the node.
    """
    told = rows.join(bounded(labels), "node", "left").select("meeting", "node", F.coalesce("label", "node").alias("label"))
    spread = told.groupBy("meeting").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    return told.join(bounded(materialize(spread, "jaccard-spread")), "meeting").select("meeting", "node", "label", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), blocks.alias("blocks"))


def _large(placed: DataFrame, sketches: DataFrame, nearest: int) -> DataFrame:
    """(a, b, more, meeting): of large meetings, as _open() gives them, for each two components the nearest pairs that sketches allow.

    more: whether the two components have further such pairs in that meeting.
    """
    dealt = placed.join(sketches, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def run(key: tuple, group: pa.Table) -> pa.Table:
        block, node, label, n = (group.column(c).to_numpy() for c in ("block", "node", "label", "n"))
        bits = [np.frombuffer(x, np.uint8) for x in group.column("sketch").to_pylist()]
        size = min(map(len, bits))
        bits = np.array([_fold(x, size) for x in bits]).view(np.uint64)
        left = np.flatnonzero(block == key[1].as_py())
        right = np.flatnonzero(block == key[2].as_py())
        found = []
        for x in left.tolist():
            to = right if key[1] != key[2] else right[right > x]
            to = to[(label[to] != label[x]) & (np.minimum(n[to], n[x]) * SHARE[1] >= np.maximum(n[to], n[x]) * SHARE[0])]
            apart = np.bitwise_count(bits[to] ^ bits[x]).sum(axis=1, dtype=np.int64)
            fit = apart <= (n[to] + n[x]) // 7
            found.append((np.full(int(fit.sum()), x), to[fit], apart[fit]))
        x, y, apart = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3)) if found else (np.zeros(0, np.int64),) * 3
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        order, first = _runs(low, high, apart)
        if len(order):
            pair_first = np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])]
            start = np.maximum.accumulate(np.where(pair_first, np.arange(len(order)), 0))
            number = np.cumsum(pair_first) - 1
            many = np.bincount(number)[number] > nearest
            kept = np.arange(len(order)) - start < nearest
            x, y, many = x[order][kept], y[order][kept], many[kept]
        else:
            many = np.zeros(0, bool)
        return pa.table([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y])), pa.array(many), pa.array([key[0].as_py()] * len(x), pa.int64())], names=["a", "b", "more", "meeting"])

    return dealt.select("meeting", "i", "j", "block", "node", "label", "n", "sketch").groupBy("meeting", "i", "j").applyInArrow(run, "a long, b long, more boolean, meeting long")


def links(documents: DataFrame, described: DataFrame) -> DataFrame:
    """(node, label): the components of all similar pairs of nodes."""
    nodes = materialize(described.where("node is not null").groupBy("node").agg(F.min("text_hash").alias("text_hash")), "jaccard-nodes")
    every = materialize(meetings(documents), "jaccard-keys")
    met = materialize(owed(every), "jaccard-meetings")
    discard(every)
    tested = materialize(_centres(met), "jaccard-pairs")
    labels = components(materialize(_similar(tested, nodes, documents), "jaccard-links"))
    apart = materialize(_apart(met, labels), "jaccard-apart")
    discard(met)
    pairs = apart.where("meeting is null").groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("need").alias("need")).where("times >= need")
    tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    small = pairs.select("a", "b").join(bounded(tested), ["a", "b"], "left_anti")
    rows, nearest = apart.where("meeting is not null").select("meeting", F.col("a").alias("node")), NEAREST
    placed = materialize(_open(rows, labels), "jaccard-open")
    sketches = materialize(_sketches(nodes, placed.select("node").distinct(), documents), "jaccard-sketches")
    while True:
        near = materialize(_large(placed, sketches, nearest), "jaccard-near")
        fresh = near.select("a", "b").distinct().join(bounded(tested), ["a", "b"], "left_anti")
        new = materialize(fresh if small is None else fresh.union(small).distinct(), "jaccard-pairs")
        labels = _joined(labels, materialize(_similar(new, nodes, documents), "jaccard-links"))
        more, of = near.where("more"), bounded(labels)
        for end in ("a", "b"):
            more = more.join(of.toDF(end, f"label_{end}"), end, "left")
        left = materialize(more.where(~F.coalesce("label_a", "a").eqNullSafe(F.coalesce("label_b", "b"))).select("meeting").distinct(), "jaccard-left")
        if left.isEmpty():
            discard(nodes, apart, sketches, near)
            return labels
        tested, small, nearest = materialize(tested.union(new), "jaccard-tested"), None, nearest * 64
        placed = placed.join(bounded(left), "meeting", "left_semi").drop("label").join(bounded(labels), "node", "left")
        placed = materialize(placed.select("meeting", "node", F.coalesce("label", "node").alias("label"), "block", "blocks"), "jaccard-open")


def _labelled(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, label) of every row; the label, of a component, is null without shingles."""
    described = materialize(describe(documents), "jaccard-sets")
    labels = links(documents, described)
    return described.select("doc_id", "text_hash", "n", "node").join(labels, "node", "left").select("doc_id", "text_hash", "n", F.coalesce("label", "node").alias("label"))


def join(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: how many shingles, and the least doc_id reachable by links."""
    told = _labelled(documents).drop("text_hash")
    first = told.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("first"))
    both = told.join(first, "label", "left")
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents, all columns kept, one of each component: the least by doc_id, null last, then by hash of the text.

    Of rows with the survivor's id and text one stays. Rows without shingles are in no component and all stay.
    """
    same = _labelled(documents).where("label is not null").groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    same = materialize(same, "jaccard-rows")
    first = same.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
    first = first.select("label", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    id_, hash_, gone = apart(documents, "_id", "_hash", "_gone")
    marked = same.join(first, "label").where(~stays | (F.col("rows") > 1)).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), (~stays).alias(gone))
    marked = materialize(marked, "jaccard-gone")
    here = [documents["doc_id"].eqNullSafe(F.col(id_)), F.xxhash64(documents["text"]) == F.col(hash_)]
    left = documents.join(bounded(marked), here, "left_anti")
    often = marked.where(~F.col(gone)).drop(gone)
    if often.isEmpty():
        return left
    copies = documents.join(bounded(often), here, "left_semi").withColumn(hash_, F.xxhash64("text"))
    return left.unionByName(copies.dropDuplicates(["doc_id", hash_]).drop(hash_))
