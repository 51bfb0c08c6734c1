"""Near copies, repeated spans and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontaminate, jaccard_join, queries, substring_dedup


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(docs):
    """doc -> least doc reachable; docs: {doc_id: text}."""
    sets = {d: shingle_set(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if find(a) != find(b) and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df).collect()}


def make(spark, docs):
    return spark.createDataFrame([(d, t, "n", 1) for d, t in docs.items()], "doc_id long, text string, node string, label int")


def test_components_of_the_documents(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op3_jaccard_join"](spark, sf).collect()} == brute_components(docs)


def test_one_of_each_with_repeated_and_null_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(3, a), (7, a + " end"), (7, b), (8, c), (8, c), (None, d), (None, d), (None, d + " end"), (None, e), (9, e), (None, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1))
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(df).collect()), key=repr)
    wanted = [(3, a), (7, b), (8, c), (9, e), (None, None), (None, " ")]
    assert [r for r in got if r not in wanted] in ([(None, d)], [(None, d + " end")]) and all(got.count(r) == 1 for r in wanted) and len(got) == 7


def edited(rng, words, share):
    return [rng.choice("qrstuvwxyz") * 3 if rng.random() < share else w for w in words]


def test_groups_of_edited_copies_with_a_common_passage(spark):
    """Copies at all distances around the threshold, a passage that most texts share, sets of three to hundreds."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    passage = [word() for _ in range(40)]
    docs = {}
    for size in (3, 6, 8, 30, 60, 90, 250, 300):
        base = [word() for _ in range(size)]
        for k in range(18):
            docs[len(docs)] = " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06])) + (passage if k % 3 == 0 else []))
    base = [word() for _ in range(120)]
    for _ in range(100):  # more than one small meeting holds
        docs[len(docs)] = " ".join(edited(rng, base, rng.choice([0, 0.02, 0.04, 0.06])))
    for _ in range(80):
        docs[len(docs)] = " ".join([word() for _ in range(rng.randint(5, 60))] + passage)
    assert found(make(spark, docs)) == brute_components(docs)


def test_blocks_of_a_large_meeting(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "NEAREST", 1)
    monkeypatch.setattr(jaccard_join, "SEEN", 0)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 2)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    docs = {k: " ".join(edited(rng, base, rng.choice([0, 0.03, 0.05, 0.07]))) for k in range(40)}
    assert found(make(spark, docs)) == brute_components(docs)


def test_odd_rows(spark):
    docs = {1: None, 2: "", 3: " \n", 4: "a b", 5: "A  B", 6: "a b c", 7: "x " * 30_000, 8: "x " * 30_001, 9: "é É", 10: "É é"}
    df = make(spark, docs)
    assert found(df) == brute_components(docs)
    more = df.union(df.where("doc_id IN (1, 4)")).union(spark.createDataFrame([(None, "a b", None, None), (None, None, None, None)], df.schema))
    rows = jaccard_join.join(more).collect()
    assert len(rows) == len(docs) + 4 and {r["component_id"] for r in rows if r["n_shingles"] == 1 and r["doc_id"] in (4, 5, None)} == {4}
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(df).collect()) == sorted(d for d, (_, c) in brute_components(docs).items() if d == c)
    assert jaccard_join.one_of_each(df).columns == df.columns
    assert jaccard_join.join(df.where("false")).collect() == []


def test_similar_sets_always_share_keys():
    rng = np.random.default_rng(0)
    for n in (3, 4, 10, 40, 63, 64, 200, 255, 256, 700, 1023, 1024, 3000, 5000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            gone = int(rng.integers(0, n // 4 + 1))
            new = int((3 * (n - gone) - 3 * n + n) // 3) if 4 * (n - gone) > 3 * n else 0
            b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 1 << 64, max(new, 0), np.uint64)])
            common = len(np.intersect1d(a, b))
            if 100 * common < 75 * (len(a) + len(b) - common):
                continue
            (own, spare), (other, other_spare) = jaccard_join.keys(a), jaccard_join.keys(b)
            shared = set(own.tolist()) & set(other.tolist())
            owed = 1 + min(spare, other_spare)
            assert len(shared) >= min(owed, 1 if n < 16 else owed) or (a.tolist() == b.tolist())
            differ = len(a) + len(b) - 2 * common
            x, y = (np.frombuffer(jaccard_join.sketch(s), np.uint8) for s in (a, b))
            size = min(len(x), len(y))
            assert np.bitwise_count(jaccard_join._fold(x, size) ^ jaccard_join._fold(y, size)).sum() <= differ


def brute_spans(docs):
    seen, out = {}, {}
    for d in sorted(docs):
        parts = substring_dedup.sentences(docs[d] or "")
        assert "".join(parts) == (docs[d] or "")
        words = [p.encode().lower().split() for p in parts]
        full = [i for i, w in enumerate(words) if w]
        runs = set()
        for a in range(len(full)):
            for step in (1, -1):
                n, b = 0, a
                while 0 <= b < len(full):
                    n += len(words[full[b]])
                    if n >= 25 and abs(b - a) >= 1:
                        runs.add((min(a, b), max(a, b)))
                        break
                    b += step
            if len(words[full[a]]) >= 50:
                runs.add((a, a))
        gone = set()
        for a, b in sorted(runs):
            key = tuple(b" ".join(words[full[i]]) for i in range(a, b + 1))
            if seen.setdefault(key, (d, a)) != (d, a):
                gone.update(range(full[a], full[b] + 1))
        out[d] = (len(parts), len(gone), "".join(p for i, p in enumerate(parts) if i not in gone))
    return out


def test_spans_of_the_documents(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"] or "") for r in queries.QUERIES["op9_substring_dedup"](spark, sf).collect()}
    assert got == brute_spans(docs)


def test_every_passage_of_fifty_words_goes(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    docs, passages = {}, []
    for k in range(40):
        lengths = rng.choice([[51], [49, 2], [2, 49], [1] * 51, [25, 26], [24, 3, 24], [10] * 6])
        passage = " ".join(sentence(n) for n in lengths)
        passages.append(passage)
        for half in (0, 1):
            docs[2 * k + half] = f"{sentence(9)}\n{passage}\n{sentence(9)}"
    got = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicate(make(spark, docs)).collect()}
    for k, passage in enumerate(passages):
        assert got[2 * k] == docs[2 * k]
        assert not any(s.strip() in got[2 * k + 1] for s in substring_dedup.sentences(passage + "\n"))


def test_spans_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30)) + ". " + "and so on it goes. "
    docs = {1: None, 2: "", 3: "\n \n", 4: long, 5: long, 6: long * 3, 7: "word " * 100_000, 8: "A. B. C. D."}
    df = make(spark, docs)
    got = {r["doc_id"]: r for r in substring_dedup.deduplicate(df).collect()}
    assert {d: (r["repeats"]["n_sentences"], r["repeats"]["n_removed"], r["text"] or "") for d, r in got.items()} == brute_spans(docs)
    assert got[1]["text"] is None and got[5]["text"] == "" and got[4]["text"] == long
    more = df.union(df.where("doc_id = 4")).union(spark.createDataFrame([(None, long, None, None)], df.schema))
    rows = substring_dedup.deduplicate(more).collect()
    assert len(rows) == len(docs) + 2 and [r["text"] for r in rows if r["doc_id"] is None] == [long]
    assert [r["text"] for r in rows if r["doc_id"] == 4] == ["", ""]
    assert substring_dedup.deduplicate(df.where("false")).collect() == []


def test_spans_of_null_and_repeated_ids(spark):
    passage = lambda x: " ".join(" ".join(f"{x}{i}{j}" for j in range(15)) + "." for i in range(4)) + "\n"
    shared, twin, named, both = (passage(x) for x in "pqrs")
    rows = [(None, shared + "One."), (None, shared + "Two."), (None, shared + "Three."), (5, twin + "One."), (5, twin + "Two.")]
    rows += [(None, named), (None, named), (None, named), (None, None), (None, None), (9, both), (None, both), (None, "Short."), (None, "Short.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1))
    got = substring_dedup.deduplicate(df)
    assert got.columns == ["doc_id", "text", "k", "repeats"]
    texts = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(texts) == len(rows)
    for p, ids in ((shared, {None}), (twin, {5}), (named, {None}), (both, {None})):
        assert [d for d, t in texts if p.strip() in (t or "")] == list(ids)
    ends = sorted(t.removeprefix(shared) for d, t in texts if d is None and t and t.endswith(("One.", "Two.", "Three.")))
    assert ends == ["One.", "Three.", "Two."]
    assert texts.count((None, "")) == 2 and texts.count((9, "")) == 1 and texts.count((None, None)) == 2 and texts.count((None, "Short.")) == 2


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = corpus_pipeline.materialize(docs, "test")
        out.append((name, before, docs))
    return out


def test_language_stage_goes_by_the_profiles(spark):
    rows = [(k, "the cat and the dog", "en") for k in range(20)] + [(k, "le chat et le chien", "fr") for k in range(20, 40)]
    rows += [(40, "Съешь ещё этих мягких булок", None), (41, "12 34 !!", "en"), (42, None, "fr"), (43, "the chat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = lambda d: sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, d, "").collect())
    assert kept(df) == [*range(40), 43]
    assert kept(df.withColumn("lang", F.lit(None).cast("string"))) == [*range(41), 43]
    alone = df.where((corpus_pipeline.fold("doc_id", 5) == 0) & (F.col("doc_id") < 41))
    assert kept(alone) == sorted(r["doc_id"] for r in alone.collect()) != []


def test_pipeline_stages(spark, sf, stages):
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = stages
    for _, _, df in stages[:-1]:
        assert df.columns == a.columns and df.schema["n_chars"].dataType == a.schema["n_chars"].dataType
    assert texts(b) == {k: t for k, t in texts(a).items() if any(ch.isalpha() for ch in t or "")}
    assert set(texts(c)) == {k for k, (_, root) in brute_components(texts(b)).items() if k == root}
    assert texts(d) == {k: t for k, (n, gone, t) in brute_spans(texts(c)).items() if gone == 0 or gone < n}
    hit = {r["doc_id"] for r in decontaminate.report(d, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    assert set(texts(e)) == set(texts(d)) - hit
    assert f.select("doc_id").distinct().count() == e.count()
    assert f.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("ok")).where("NOT ok").isEmpty()


def test_run_equals_its_stages(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first() == stages[-1][2].agg(F.sum("length")).first()


CLASHING = ["_id", "_hash", "_gone", "positions", "_positions", "items", "_doc_id", "_text_hash", "_cut_doc", "_cut_hash", "_cut_at", "_cut_size", "_copy", "_cut", "Repeats", "lang_id", "node", "label", "rows", "n", "key", "span"]


def test_any_names_of_extra_columns(spark, sf):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from quarry.llm import decontaminate, jaccard_join, langid, substring_dedup
    from quarry.llm.common import table

    plain = table(spark, sf, "documents").where("doc_id < 60")
    plain = plain.unionByName(plain.where("doc_id < 5")).unionByName(plain.where("doc_id BETWEEN 5 AND 9").withColumn("doc_id", F.lit(None).cast("long")))
    docs = plain.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
    benchmark = table(spark, sf, "benchmark")
    rows = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect())
    for apply in (lambda d: decontaminate.remove_spans(d, benchmark), lambda d: decontaminate.remove_documents(d, benchmark), jaccard_join.one_of_each, lambda d: langid.predict(d, langid.learn_profiles(d), told="told_lang")):
        done = apply(docs)
        assert [c for c in done.columns if c != "told_lang"] == docs.columns and rows(done) == rows(apply(plain))
        assert all(r[c] == k for r in done.collect() for k, c in enumerate(CLASHING))
    done = substring_dedup.deduplicate(docs)
    assert sorted(done.columns) == sorted([c for c in docs.columns if c != "Repeats"] + ["repeats"]) and rows(done) == rows(substring_dedup.deduplicate(plain))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left, same = stage(spark, docs, sf), stage(spark, plain, sf)
        assert left.columns == docs.columns and rows(left) == rows(same), name


def test_copies_without_an_id_are_removed_but_one(spark):
    from quarry.llm import substring_dedup

    text = "One two three four five six seven eight nine ten. " * 6
    df = spark.createDataFrame([(None, text)] * 20 + [(None, "Short one."), (None, None), (None, None)], "doc_id long, text string").repartition(5)
    left = [r["text"] for r in substring_dedup.deduplicate(df).collect()]
    assert sorted(map(str, left)).count("") == 19 and left.count(None) == 2 and left.count("Short one.") == 1
