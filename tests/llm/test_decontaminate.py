from compare import assert_same

from quarry.llm import decontaminate, queries


def brute(docs, items, n=10):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[k]
        out.append((doc, len(w), len(hit), len(found)))
    return sorted(out, key=str)


def test_sql(spark, sf, duck):
    assert_same(queries.QUERIES["op1_decontamination"](spark, sf), duck, decontaminate.SQL)


ITEMS = [(1, "One two THREE four five six seven eight nine ten eleven"), (2, "short Item"), (3, None), (4, ""), (5, "É"), (6, "short item"), (None, "nobody knows")]
DOCS = [
    (1, "x one two three four, five six seven eight nine ten y"), (2, "a short item and a SHORT-ITEM"), (3, None), (4, ""), (5, "é É é"), (6, "one two three"), (None, "short item"), (7, "same short item"), (7, "same short item"), (8, "w " * 5000 + "short item"), (9, "nobody knows"),
]


def tables(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame([(d, t, 0, "k") for d, t in docs], "doc_id long, text string, n int, items string"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")


def test_edges_against_brute_force(spark):
    docs, items = tables(spark)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.report(docs, items).collect()), key=str)
    want = brute(DOCS, [(i, t) for i, t in ITEMS])
    named = [(d, w, h, n if d != 9 else 0) for d, w, h, n in want]  # an item without id hits but is not named
    assert got == sorted(named, key=str)


def test_shuffled_join_gives_the_same(spark):
    docs, items = tables(spark)
    hits = lambda most: sorted((str(r["doc_id"]), sorted(r["positions"])) for r in decontaminate.scan(docs, items, broadcast_windows=most).collect())
    assert hits(0) == hits(1000)


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert decontaminate.report(docs.where("false"), items).collect() == []
    assert {r["n_hit"] for r in decontaminate.report(docs, items.where("false")).collect()} == {0}


def test_removal(spark):
    docs, items = tables(spark)
    assert sorted(str(r["doc_id"]) for r in decontaminate.remove_documents(docs, items).collect()) == ["3", "4", "6"]
    kept = {r["doc_id"]: r for r in decontaminate.remove_spans(docs, items).collect()}
    assert kept[2]["text"] == "a and a" and kept[6]["text"] == "one two three" and kept[3]["text"] is None
    assert decontaminate.remove_spans(docs, items).columns == docs.columns
    assert decontaminate.remove_spans(docs, items).count() == len(DOCS)
