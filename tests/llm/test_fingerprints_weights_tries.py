"""Near copies by fingerprints, importance resampling and the trie of prefixes, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import prefix_trie, resampling, simhash


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least place reachable by links of up to two bits, for each place."""
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    points = np.array(prints, np.uint64)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= 2).tolist():
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprints_and_components(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    top = max(d for d, _ in docs) + 1
    docs += [(top + 1, None), (top + 2, ""), (top + 3, " \n"), (top + 4, "One"), (top + 5, "one\x0b"), (top + 6, "é Ü x"), (None, docs[0][1]), (None, "alone, without an id"), docs[3], docs[3]]
    rows = [(d, t, 1, "x", 2, None, 3) for d, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, print int, shard string, component_id int, label int, node int")
    prints = [plain_print(t) for _, t in docs]
    first = plain_components(prints)
    least = {}
    for (d, _), k in zip(docs, first, strict=True):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    want = sorted((str(d), p, str(least.get(k))) for (d, _), p, k in zip(docs, prints, first, strict=True))
    got = sorted((str(r["doc_id"]), r["print"] % 2**64, str(r["component_id"])) for r in simhash.near_copies(df).collect())
    assert got == want
    assert len({c for *_, c in want}) < len({d for d, *_ in want})


def test_empty_tables(spark):
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_a_long_text_is_read_in_pieces(monkeypatch):
    text = " ".join(f"W{k % 97}" for k in range(5000))
    want = plain_print(text)
    assert simhash.fingerprint(text) == want
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("two Words") == plain_print("two words")


def clouds(seed):
    """Distinct prints: some at random, chains of single flips, and a dense cube."""
    rng = np.random.default_rng(seed)
    points = [rng.integers(0, 2**64, 700, np.uint64)]
    for _ in range(10):
        at, chain = int(rng.integers(0, 2**63)), []
        for _ in range(40):
            at ^= 1 << int(rng.integers(0, 64)) | 1 << int(rng.integers(0, 64))
            chain.append(at)
        points.append(np.array(chain, np.uint64))
    cube = int(rng.integers(0, 2**63))
    points.append(np.array([cube ^ sum(1 << 3 * b for b in range(10) if k >> b & 1) for k in range(0, 1024, 3)], np.uint64))
    return np.unique(np.concatenate(points))


def test_local_search_prunes_nothing_that_links(monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 24)
    for seed in range(4):
        points = clouds(seed)
        assert simhash.roots(points).tolist() == plain_components(points.tolist())
    monkeypatch.setattr(simhash, "SHRINKS", 0.0)  # nothing splits: all against all, in blocks
    assert simhash.roots(points).tolist() == plain_components(points.tolist())


def test_trees_bring_linked_pairs_together():
    for seed in range(4):
        points = clouds(seed)
        tree = simhash.grow(points[::3], 30)
        leaf, place = simhash.route(tree, points)
        at = defaultdict(set)
        for x, k in zip(leaf.tolist(), place.tolist(), strict=True):
            at[k].add(x)
        for i in range(len(points)):
            for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= 2).tolist():
                assert at[i] & at[j]
        assert max(Counter(leaf.tolist()).values()) < len(points)
    assert simhash.grow(np.array([5], np.uint64), 0) is None


@pytest.mark.parametrize("shrinks", [0.95, 0.0])
def test_shards_are_split_until_they_fit(spark, monkeypatch, many_ranges, shrinks):
    for name, value in (("LEAF", 100), ("SAMPLE", 60), ("CHUNK", 50)):
        monkeypatch.setattr(simhash, name, value)
    if not shrinks:
        monkeypatch.setattr(simhash, "grow", lambda sample, leaf: None)
    points = clouds(9)
    nodes = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "print long")
    every, _ = simhash.shards(nodes)
    sizes = [r["count"] for r in every.groupBy("shard").count().collect()]
    assert (max(sizes) <= 100 and len(sizes) > 5) if shrinks else len(sizes) == 1
    place = {int(x): k for k, x in enumerate(points.view(np.int64))}
    up = list(range(len(points)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in simhash.links(nodes).collect():
        x, y = root(place[a]), root(place[b])
        up[max(x, y)] = min(x, y)
    assert [root(x) for x in range(len(points))] == plain_components(points.tolist())


def plain_draw(docs, target, hi, buckets=10_000, percent=10, least=20):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return words, [" ".join(words[i : i + n]) for n in range(1, hi + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in rows for f in features(x)[1]) for rows in (docs, target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * float(S + buckets) / ((s[b] + 1) * float(T + buckets)))) for b in s}
    out = []
    for d, x in docs:
        words, found = features(x)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = able[: percent * len(able) // 100]
    return out, drawn


@pytest.mark.parametrize(("hot", "hi"), [(100_000, 1), (40, 2)])
def test_importance_resampling(spark, sf, monkeypatch, many_ranges, hot, hi):
    monkeypatch.setattr(resampling, "HOT", hot)
    monkeypatch.setattr(resampling, "CHUNK", 2000)
    monkeypatch.setattr(resampling, "PIECE", 300)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs += [(None, None), (-1, ""), (-2, "a b"), (None, docs[0][1])] + [(-3, target[0][1] + " word" * 20)] * 7
    df = spark.createDataFrame([(d, x, 1, "w", 2.0, 3) for d, x in docs], "doc_id long, text string, row int, feature string, weight double, text_hash int")
    found = resampling.resample(df, spark.createDataFrame(target, "item_id long, text string"), hi=hi)
    every, drawn = plain_draw(docs, target, hi)
    ranks = defaultdict(list)
    for k, r in enumerate(drawn, 1):
        ranks[r].append(k)
    want = []
    for r in every:
        own = ranks[r]
        want.append((str(r[0]), *r[1:4], own.pop(0) if own else None))
    order = lambda rows: sorted(rows, key=str)
    got = [(str(r[0]), *r[1:]) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert order(got) == order(want)
    taken = resampling.draw(df, found)
    assert taken.columns == df.columns
    text = {(d, w): x for (d, x), (_, _, w, _, _) in zip(docs, every, strict=True)}
    assert sorted((str(r["doc_id"]), r["text"]) for r in taken.collect()) == sorted((str(r[0]), text[r[0], r[2]]) for r in drawn)


def test_a_group_of_equal_rows_is_cut_at_the_border(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(30)))] * 25 + [(2, "x " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = resampling.resample(df, df.limit(0))
    assert resampling.draw(df, found).count() == 2
    assert sorted(r["rank"] for r in found.where("rank is not null").collect()) == [1, 2]


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        own[c].append((role or "", text or ""))
    path = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members, ended = defaultdict(list), defaultdict(list)
    for c, p in sorted(path.items()):
        ended[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, ended[p])).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def made_conversations():
    rows = []
    for c in [*range(-5, 65), 1000, 70_000, 140_001]:
        for t in range(c % 7):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {'all' if t < 3 else c % 5}"))
    rows += [(7, None, "system", "first of all"), (8, 9, None, None), (8, 10, "user", ""), (None, 1, "user", "no conversation")]
    rows += [(40, 100 + k, "user", f"long {k}") for k in range(900)]
    rows += [(41, 100 + k, "user", f"long {k}") for k in range(500)]
    rows += [(c, k, "user", "same") for c in range(200, 400) for k in range(2)]
    return rows


def test_trie_of_prefixes(spark, sf, many_ranges, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    monkeypatch.setattr(prefix_trie, "LIST_BITS", 4)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for rows in (made_conversations(), given):
        df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, at string, part int")
        found = prefix_trie.trie(df)
        assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(plain_trie(rows), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_values_are_carried_over_ranges(spark, many_ranges):
    rows = [(7, k, 3 * k + 1) for k in range(300)] + [(c, 0, c) for c in (1, 2, 9)]
    df = spark.createDataFrame(rows, "conv_id long, at long, x long")
    written, carry, parts = prefix_trie.scan(df, [F.asc("conv_id"), F.asc("at")], {"v": ("x", 5)}, "scan")
    assert parts > 2 and carry.where("seen_before > 0").count() >= 2
    total = 0
    for k in range(300):
        total = (total * 5 + 3 * k + 1) % 2**64
    told = prefix_trie._carried(written, carry).where("last and conv_id = 7").collect()
    assert len(told) == 1
    assert (told[0]["v"] + told[0]["v_before"] * pow(5, told[0]["seen"], 2**64)) % 2**64 == total
