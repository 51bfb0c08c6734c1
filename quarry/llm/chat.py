"""Chat formatting of reply trees with DataFrame functions only.

Messages form trees by parent. Iterated self-joins with doubled step length list every root-to-leaf path, each
message of a path exactly once; branches of a tree are ranked by score, and each chosen path becomes one string
with marked turns and a loss mask over the assistant's texts.

Nulls and ties: null texts and roles count as empty; messages without tree or node id form their own group or are
told apart by the row order (turn, role, text). Repeated rows stay as turns of their own. A parent that does not
exist makes its child a root. Messages that repeat a node id of their tree share its place on each path, under the
least of their parents. Where parents form a cycle, or a node is its own parent, the least node of the cycle is the
root. Branches of equal score rank by leaf id. Empty tables give empty results. Columns
other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings that chat models act on; each starts with < or [ and holds neither of them again.
CONTROL = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|/?SYS>|\|system\|>|\|user\|>|\|assistant\|>"


def escape(text: Column) -> Column:
    """Puts one more ~ after the first character of every control string, so that none is left; unescape() undoes it."""
    return F.regexp_replace(text, rf"([<\[])(~*)({CONTROL})", "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])~(~*)({CONTROL})", "$1$2$3")


def replies(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: (tree, node, parent, role, text, score); each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("bigint")
    return conversations.select(F.col("conv_id").alias("tree"), node.alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score")
    )


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every message on the way from each leaf to its root, up: steps above the leaf.

    Each round joins what is known with the ancestor twice as far up, so a tree of depth d takes log2(d) rounds,
    and no round makes more rows than the result has. A message whose way up is longer than its tree is on a cycle or
    below one.
    """
    links = messages.groupBy("tree", "node").agg(F.min("parent").alias("parent"))
    longest = links.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    found, roots = _paths(links, longest)
    return found if roots is None else _paths(_with_roots(links, roots), longest)[0]


def _with_roots(links: DataFrame, roots: DataFrame) -> DataFrame:
    cut = roots.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.lit(True).alias("cut"))
    marked = links.join(cut, links["tree"].eqNullSafe(cut["t"]) & (links["node"] == cut["n"]), "left")
    return materialize(marked.select("tree", "node", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent")), "chat-links")


def _paths(links: DataFrame, longest: int) -> tuple[DataFrame, DataFrame | None]:
    """paths(), and the least node (tree, node) of each cycle, if there are any; then the paths are not complete."""
    known = links.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    child = links.where("parent is not null")
    jump = materialize(child.join(known, child["tree"].eqNullSafe(known["t"]) & (child["parent"] == known["n"])).select("tree", "node", F.col("parent").alias("above"), F.col("parent").alias("least")), "chat-jump")
    inner = jump.select(F.col("tree").alias("t"), F.col("above").alias("n")).distinct()
    found = links.join(inner, links["tree"].eqNullSafe(inner["t"]) & (links["node"] == inner["n"]), "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up"))
    step = 1
    while not jump.isEmpty():
        if step > longest:
            return found, materialize(jump.where("node = least").select("tree", "node"), "chat-cycles")
        hop = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("a"), F.col("least").alias("l"))
        further = found.join(hop, found["tree"].eqNullSafe(hop["t"]) & (found["node"] == hop["n"])).select("tree", "leaf", F.col("a").alias("node"), (F.col("up") + step).alias("up"))
        found = found.unionByName(materialize(further, "chat-paths"))
        onward = jump.join(hop, jump["tree"].eqNullSafe(hop["t"]) & (jump["above"] == hop["n"])).select("tree", "node", F.col("a").alias("above"), F.least("least", "l").alias("least"))
        jump = materialize(onward, "chat-jump")
        step *= 2
    return found, None


def ranked_branches(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, turns): each branch's messages from the root, ranked in its tree by mean score, best first.

    branches: how many of each tree to keep; None keeps all.
    """
    messages = materialize(messages, "chat-messages")
    on = paths(messages)
    told = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text", "score")
    full = on.join(told, on["tree"].eqNullSafe(told["t"]) & (on["node"] == told["n"]))
    each = full.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    ranked = each.select("tree", "leaf", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")).alias("rank"), "turns")
    return ranked if branches is None else ranked.where(F.col("rank") <= branches)


def format_turns(branches: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans): the marked string, and start (from 1) and length of each assistant text in it."""
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body")))
    placed = branches.select("tree", "leaf", "rank", parts.alias("parts")).select("tree", "leaf", "rank", "parts", F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")).alias("formatted"))
    # the start of each body: all before it plus its own head
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.lit(len(END))).alias("at"),
            F.when(p["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return placed.select("tree", "leaf", "rank", "formatted", spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array of (role, text) from a formatted string: the inverse of format_turns()."""
    marked = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x, i: i > 0)
    body = lambda x: F.substring_index(F.substring_index(x, SEP, -1), END, 1)
    return F.transform(marked, lambda x: F.struct(unescape(F.substring_index(x, SEP, 1)).alias("role"), unescape(body(x)).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """The query's columns, read back from the formatted strings and their loss masks."""
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"], s["length"]))), "")
    return formatted.select("tree", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: The conversation that the query adds: its texts are control strings themselves.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(~*)({CONTROL})', '\1~\2\3', 'g') AS t, regexp_replace(role, '([<\[])(~*)({CONTROL})', '\1~\2\3', 'g') AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(t) + length(r) + {len(START + SEP + END)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
