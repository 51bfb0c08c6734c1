"""The trie of conversation prefixes, from mergeable partial tries.

Texts leave at once: a turn is two hashes of its role and text and a number of words. Turns are sorted in ranges, so
that one long conversation can run through several tasks; each task computes running values of its part, and what the
ranges before have left over (two rows a range) is carried in afterwards. A node is named by its depth and two
running polynomials of the turns' hashes, each modulo 2 ** 64, so the name of any prefix is known without its text.

Each task combines the nodes that it sees into a partial node table; tables are merged by node, FAN slots at a time,
until one is left: members are summed, the least member is kept, and ids of conversations that end at a node are
merged in lists of up to 2 ** 16 neighbouring ids, of which digests are read one after the other. The rollup needs no
round for each level. Every node counts once, at its least member; along that conversation's path sums run from
its end to the root, and each node adds the sums that its members bring.

Nulls and ties: turns are ordered by turn, null first, then by role and hash of the text; a null role or text is empty.
Rows without conv_id belong to no conversation and are left out. A conversation whose turns are all replaced by
nothing is a member of the root only, and ends there. Without conversations there is no root and the result is empty.
Columns other than conv_id, turn, role and text are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded, discard, map_arrow, materialize

#: A family of conversations shares the first turns of its first; how many, is drawn below HEADS.
FAMILY, HEADS = 20, 4
#: Odd multipliers of the two polynomials.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Slots of partial tables that are merged at a time, rows that a task combines at a time, ids of a list.
FAN, COMBINED, LIST_BITS = 64, 1 << 17, 16

NODE = ["depth", "name_1", "name_2"]


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def scan(rows: DataFrame, order: list[Column], sums: dict[str, tuple[str, int]], name: str, descending: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """rows, written, with running values within each conversation (conv_id) and range, what to carry in, and the number of ranges.

    For each (column, m) of sums a running value v becomes v * m + column, modulo 2 ** 64. Added are part, the range;
    seen, how many rows of the conversation the range has had; last, whether the row is the conversation's last in it.
    The second table has (part, conv_id, seen_before, <sum>_before) where a conversation began in an earlier range,
    and (part, conv_id, goes_on) where it goes on in a later one: two rows a range at most.
    """
    columns, made = rows.columns, [*sums]
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv, seen, state = None, None, 0, [0] * len(made)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("conv_id").to_numpy()
            fresh = np.r_[ids[0] != conv, ids[1:] != ids[:-1]]
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            goes_on = start < 0
            out = [np.arange(n) - np.maximum(start, 0) + 1 + np.where(goes_on, seen, 0)]
            for k, (column, m) in enumerate(sums.values()):
                up, down = _powers(m, n), _powers(pow(m, -1, 2**64), n)
                total = np.cumsum(batch.column(column).to_numpy().astype(np.int64).view(np.uint64) * down[:n], dtype=np.uint64)
                before = np.where(goes_on | (start == 0), np.uint64(0), total[np.maximum(start, 1) - 1])
                out.append(((total - before) * up[:n] + np.where(goes_on, up[1 : n + 1] * np.uint64(state[k]), np.uint64(0))).view(np.int64))
            if held is not None:
                yield held.append_column("last", pa.array([bool(fresh[0])]))
            conv, seen, state = ids[-1], int(out[0][-1]), [int(v[-1]) & (2**64 - 1) for v in out[1:]]
            told = batch
            for c, v in zip(["seen", *made], out, strict=True):
                told = told.append_column(c, pa.array(v))
            yield told.slice(0, n - 1).append_column("last", pa.array(fresh[1:]))
            held = told.slice(n - 1)
        if held is not None:
            yield held.append_column("last", pa.array([True]))

    schema = ", ".join([f"{c} {t}" for c, t in rows.dtypes] + [f"{c} long" for c in ["seen", *made]] + ["last boolean"])
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialize(map_arrow(ranged, run, schema).withColumn("part", F.spark_partition_id()), name)
    ends = written.where("last").groupBy("part")
    kept, place = F.struct("conv_id", "seen", *made), -F.col("conv_id") if descending else F.col("conv_id")
    first_last = ends.agg(F.min_by(kept, place).alias("first"), F.max_by(kept, place).alias("last")).orderBy("part").collect()
    carried, on, current, before = {}, set(), None, 0
    for row in first_last:
        if current and current["conv_id"] == row["first"]["conv_id"]:
            carried[row["part"], current["conv_id"]] = (current["seen"], *(current[c] for c in made))
            on.add((before, current["conv_id"]))
        alone = row["first"]["conv_id"] == row["last"]["conv_id"]
        if alone and current and current["conv_id"] == row["last"]["conv_id"]:
            after = {"conv_id": current["conv_id"], "seen": current["seen"] + row["last"]["seen"]}
            for c, (_, m) in sums.items():
                after[c] = _signed(current[c] * pow(m, row["last"]["seen"], 2**64) + row["last"][c])
            current = after
        else:
            current = row["last"].asDict()
        before = row["part"]
    data = [(p, c, *carried.get((p, c), (0,) * (1 + len(made))), (p, c) in on) for p, c in sorted({*carried, *on})]
    schema = "part int, conv_id long, seen_before long, " + "".join(f"{c}_before long, " for c in made) + "goes_on boolean"
    return written.select(*columns, "part", "seen", *made, "last"), spark.createDataFrame(data, schema), before + 1


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _carried(written: DataFrame, carry: DataFrame) -> DataFrame:
    """The rows with what is carried in beside them (0 where nothing is), and last true at the end of a conversation only."""
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in carry.columns if c.endswith("_before")]
    last = F.col("last") & ~F.coalesce(F.col("goes_on"), F.lit(False))
    joined = written.join(F.broadcast(carry), ["part", "conv_id"], "left")  # two rows a range at most
    return joined.select(*[last.alias("last") if c == "last" else F.col(c) for c in written.columns], *zero)


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, hash_1, hash_2, words) of every turn: at counts the turns of a conversation from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("hash_1"), F.xxhash64(text, F.lit(1), role).alias("hash_2"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("hash_1"), F.asc("hash_2")]
    written, carry, _ = scan(rows, order, {}, "trie-turns")
    return _carried(written, carry).select("conv_id", (F.col("seen") + F.col("seen_before")).alias("at"), "hash_1", "hash_2", "words")


def with_shared_starts(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Turns as numbered() gives them, rebuilt, with a row of at = 0 for each conversation; at tells the order.

    The first turns of a conversation, as many as crc32 of its id modulo heads, are those of the family's first.
    """
    taken = lambda c: (F.crc32(F.col(c).cast("string").cast("binary")) % heads).alias("taken")
    ids = turns.groupBy("conv_id").agg(F.lit(0).cast("long").alias("at")).select("conv_id", "at", taken("conv_id"))
    first = F.col("conv_id") - F.col("conv_id") % family
    firsts = turns.where((first == F.col("conv_id")) & (F.col("at") < heads)).groupBy(F.col("conv_id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("at", "hash_1", "hash_2", "words"))).alias("turns"))
    shared = ids.where("taken > 0").withColumn("of", first).join(firsts, "of").select("conv_id", F.explode(F.slice("turns", F.lit(1), F.col("taken").cast("int"))).alias("t")).select("conv_id", "t.*")
    own = turns.select("*", taken("conv_id")).where("at > taken").drop("taken").withColumn("at", F.col("at") + heads)
    zero = F.lit(0).cast("long")
    tops = ids.select("conv_id", "at", zero.alias("hash_1"), zero.alias("hash_2"), zero.alias("words"))
    return tops.unionByName(shared).unionByName(own)


def paths(turns: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, part, depth, name_1, name_2, above_1, above_2, words, last) of each prefix, written, and the number of ranges."""
    multipliers = {"name_1": ("hash_1", FIRST), "name_2": ("hash_2", SECOND)}
    written, carry, parts = scan(turns, [F.asc("conv_id"), F.asc("at")], multipliers, "trie-prefixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy().astype(np.int64)  # noqa: B023, E731
            seen, names, above = get("seen"), [], []
            for c, (column, m) in multipliers.items():
                power = np.array([pow(m, k, 2**64) if before else 0 for k, before in zip(seen.tolist(), get("seen_before").tolist(), strict=True)], np.uint64)
                full = get(c).view(np.uint64) + power * get(f"{c}_before").view(np.uint64)
                names.append(full.view(np.int64))
                above.append(((full - get(column).view(np.uint64)) * np.uint64(pow(m, -1, 2**64))).view(np.int64))
            columns = [batch.column("conv_id"), batch.column("part"), pa.array(seen + get("seen_before") - 1), *map(pa.array, names), *map(pa.array, above), batch.column("words"), batch.column("last")]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", *NODE, "above_1", "above_2", "words", "last"])

    told = map_arrow(_carried(written, carry), run, "conv_id long, part int, depth long, name_1 long, name_2 long, above_1 long, above_2 long, words long, last boolean")
    found = materialize(told, "trie-paths")
    discard(written)
    return found, parts


def partial_tries(prefixes: DataFrame) -> DataFrame:
    """(slot, depth, name_1, name_2, above_1, above_2, words, n_convs, conv_id): what each task's conversations add to a node."""
    whole = ["part", *NODE, "above_1", "above_2", "words", "conv_id"]

    def combined(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = [*NODE, "above_1", "above_2", "words"]
        found = table.group_by(key).aggregate([("part", "min"), ([], "count_all"), ("conv_id", "min")])
        yield from found.select(["part_min", *key, "count_all", "conv_id_min"]).rename_columns(["slot", *key, "n_convs", "conv_id"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= COMBINED:
                yield from combined(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from combined(pa.Table.from_batches(held))

    return map_arrow(prefixes.select(*whole), run, "slot int, depth long, name_1 long, name_2 long, above_1 long, above_2 long, words long, n_convs long, conv_id long")


def merged(tries: DataFrame, slots: int) -> DataFrame:
    """One node table of partial ones: FAN slots are merged at a time, by node, until one is left."""
    while True:
        slots = -(-slots // FAN)
        key = [F.floor(F.col("slot") / FAN).cast("int").alias("slot")] if slots > 1 else []
        sums = [F.max("above_1").alias("above_1"), F.max("above_2").alias("above_2"), F.max("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")]
        tries = tries.groupBy(*key, *NODE).agg(*sums)
        if not key:
            return tries


def ends(prefixes: DataFrame) -> DataFrame:
    """(depth, name_1, name_2, n_ends, ends_sha256): digest of the ids of the conversations that end at a node, in order."""
    lists = prefixes.where("last").groupBy(*NODE, F.shiftright("conv_id", LIST_BITS).alias("list")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = lists.select(*NODE, "list", F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n, digest = None, 0, hashlib.sha256()
        for batch in batches:
            out = []
            for *key, count, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "n", "ids"]), strict=True):
                if key == node:
                    digest.update(b",")
                else:
                    if node:
                        out.append((*node, n, digest.hexdigest()))
                    node, n, digest = key, 0, hashlib.sha256()
                digest.update(ids.encode())
                n += count
            yield rows(out)
        if node:
            yield rows([(*node, n, digest.hexdigest())])

    kinds = [pa.int64()] * 4 + [pa.string()]
    rows = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [*NODE, "n_ends", "ends_sha256"])
    return map_arrow(joined.repartition(*NODE).sortWithinPartitions(*NODE, "list").drop("list"), run, "depth long, name_1 long, name_2 long, n_ends long, ends_sha256 string")


def rollup(prefixes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(depth, name_1, name_2, n_leaves, saved_tokens, n_children): sums over each node's subtree, and its children; and the table written for it."""
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saves"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"))
    steps = prefixes.select("conv_id", *NODE).join(own, ["conv_id", "depth"], "left").fillna(0, ["saves", "leaf"])
    written, carry, _ = scan(steps, [F.desc("conv_id"), F.desc("depth")], {"saved_tokens": ("saves", 1), "n_leaves": ("leaf", 1)}, "trie-sums", descending=True)
    zero = F.lit(0).cast("long")
    sums = _carried(written, carry).select(*NODE, *[(F.col(c) + F.col(f"{c}_before")).alias(c) for c in ("n_leaves", "saved_tokens")], zero.alias("n_children"))
    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("above_1").alias("name_1"), F.col("above_2").alias("name_2"), zero.alias("n_leaves"), zero.alias("saved_tokens"), F.lit(1).cast("long").alias("n_children"))
    return sums.unionByName(children).groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children")]), written


def build(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of turns as with_shared_starts() gives them, each with its sums and its parent's conv_id."""
    prefixes, parts = paths(turns)
    merged_nodes = merged(partial_tries(prefixes), parts)
    none = hashlib.sha256().hexdigest()
    nodes = materialize(merged_nodes.join(ends(prefixes), NODE, "left").fillna({"n_ends": 0, "ends_sha256": none}), "trie-nodes")
    rolled, steps = rollup(prefixes, nodes)
    sums = materialize(nodes.join(rolled, NODE), "trie-rolled")
    discard(prefixes, nodes, steps)
    above = bounded(sums.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("name_1").alias("above_1"), F.col("name_2").alias("above_2"), F.col("conv_id").alias("parent_conv_id")))
    return sums.join(above, ["depth", "above_1", "above_2"], "left")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the rebuilt conversations."""
    turns = numbered(conversations)
    found = build(with_shared_starts(turns))
    discard(turns)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::INT, 2))::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""

SQL = f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS w FROM turns)),
own AS (SELECT conv_id, pos + {HEADS} AS pos, role, text FROM turns JOIN ids USING (conv_id) WHERE pos > h),
shared AS (SELECT i.conv_id, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % {FAMILY} AND t.pos <= i.h),
rebuilt AS (SELECT * FROM own UNION ALL SELECT * FROM shared UNION ALL SELECT conv_id, 0, '', '' FROM ids),
hashed AS (SELECT conv_id, pos, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, sha256(octet_length(encode(role)) || ':' || role || text) AS x FROM rebuilt),
steps AS (SELECT conv_id, row_number() OVER p - 1 AS depth, words, sha256(string_agg(x, '') OVER p) AS node, count(*) OVER (PARTITION BY conv_id) AS n FROM hashed WINDOW p AS (PARTITION BY conv_id ORDER BY pos)),
linked AS (SELECT conv_id, depth, words, node, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above, depth = n - 1 AS ended FROM steps),
nodes AS (SELECT node, any_value(above) AS above, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, count(*) FILTER (WHERE ended) AS n_ends,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256 FROM linked GROUP BY node),
sums AS (SELECT l.node, count(*) FILTER (WHERE y.n_ends = y.n_convs) AS n_leaves, CAST(sum((y.n_convs - 1) * y.words) AS BIGINT) AS saved_tokens
  FROM nodes y JOIN linked l ON l.conv_id = y.conv_id AND l.depth <= y.depth GROUP BY l.node),
children AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN children c ON c.node = n.node LEFT JOIN nodes p ON p.node = n.above
"""
