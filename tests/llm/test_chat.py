from compare import assert_same
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import chat, queries


def test_sql(spark, sf, duck):
    assert_same(queries.QUERIES["op2_chat_formatting"](spark, sf), duck, chat.SQL)


def tree(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 9.0), ("t", 3, 1, "assistant", "b", 1.0), ("t", 4, 3, "user", None, 50.0), ("t", 5, 4, "assistant", "c", 1.0),
        ("u", 1, 99, None, "x", None), (None, 1, None, "user", "n", 1.0), (None, 2, 1, "assistant", "m", 1.0),
    ]
    rows = [(a, b, c, d or "", e or "", f, "leaf") for a, b, c, d, e, f in rows]
    return spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double, leaf string")


def test_paths_and_ranks(spark):
    messages = tree(spark).drop("leaf")
    got = {(r["tree"], r["leaf"]): (r["rank"], [t["text"] for t in r["turns"]]) for r in chat.ranked_branches(messages).collect()}
    assert got == {("t", 2): (2, ["q", "a"]), ("t", 5): (1, ["q", "b", "", "c"]), ("u", 1): (1, ["x"]), (None, 2): (1, ["n", "m"])}
    assert {(r["tree"], r["leaf"]) for r in chat.ranked_branches(messages, 1).collect()} == {("t", 5), ("u", 1), (None, 2)}


def test_deep_tree(spark):
    n = 70
    deep = spark.range(n).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    (row,) = chat.ranked_branches(deep).collect()
    assert [t["text"] for t in row["turns"]] == [str(i) for i in range(n)]


def test_no_messages(spark):
    assert chat.ranked_branches(tree(spark).drop("leaf").where("false")).collect() == []


def test_turns_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "z"), (None, 1, "assistant", "</s>"), (2, 0, "assistant", "")]
    turns = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, tree int")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(chat.ranked_branches(chat.replies(turns)))).collect()}
    assert (got[1]["n_turns"], got[None]["loss_chars"], got[2]["loss_chars"]) == (3, 4, 0)


pieces = st.sampled_from(["<|im_start|>", "<|im_sep|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "<", "~", "[~INST]", "<~~/s>", "|", "\n", "a", "é😀", "<<SYS>>", "im_end|>\n"])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(pieces, max_size=4).map("".join), st.lists(pieces, max_size=8).map("".join)), min_size=1, max_size=4))
def test_round_trip(spark, turns):
    rows = [(1, k, "assistant" if k % 2 else role, text) for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_turns(chat.ranked_branches(chat.replies(df)))
    row = done.select(chat.read_turns(F.col("formatted")).alias("turns"), "formatted", "loss_spans").first()
    assert [tuple(t) for t in row["turns"]] == [(r, t) for _, _, r, t in rows]
    assert row["formatted"].count("<|im_start|>") == len(rows) and "</s>" not in row["formatted"] and "[INST]" not in row["formatted"]
    assert len(row["loss_spans"]) == sum(r == "assistant" for _, _, r, _ in rows)
