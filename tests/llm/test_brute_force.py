"""Operators that SQL cannot express, against plain Python written from their descriptions."""

import json
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, html_extract, jaccard_join, langid, media, quality, substring_dedup, token_files
from quarry.llm.common import fold, shared_path


def plain_grams(text):
    """n-grams of one to three letters; a run of other characters is one space, and one stands at each end."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return []
    line = " " + " ".join(words) + " "
    return [line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if line[i : i + n] != " "]


def code(gram):
    return sum(ord(c) << 21 * k for k, c in enumerate(gram))


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_language_profiles_distances_and_winners(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.withColumn("train", fold("doc_id", 5) != 0).collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r["train"] and r["lang"] is not None:
            counts[r["lang"]].update(plain_grams(r["text"] or ""))
    profiles = {lang: ranked(c, langid.PROFILE) for lang, c in counts.items()}
    found = langid.learn_profiles(docs.where(fold("doc_id", 5) != 0))
    assert {k: v.tolist() for k, v in found.items()} == {k: list(map(code, v)) for k, v in profiles.items()}
    model = langid.Model(found)
    for r in rows[:60]:
        own = ranked(Counter(plain_grams(r["text"] or "")), langid.DOCUMENT)
        told = model.predict(r["text"])
        if not own:
            assert told[0] == "und"
            continue
        distances = {}
        for lang, profile in sorted(profiles.items()):
            place = {g: k for k, g in enumerate(profile)}
            distances[lang] = sum(abs(place[g] - k) if g in place else langid.PROFILE for k, g in enumerate(own))
        best, second = sorted(distances.values())[:2]
        assert told[0] == min(distances, key=lambda x: (distances[x], x))
        assert told[1] == pytest.approx(second / (best + second))


def test_quality_equations_and_pools(spark):
    rng = np.random.default_rng(5)
    stats = rng.normal(size=(400, quality.N_STATISTICS))
    labels = (stats[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    frame = spark.createDataFrame([(i, [float(x) for x in s], float(y)) for i, (s, y) in enumerate(zip(stats, labels, strict=True))], "doc_id long, stats array<double>, label double")
    model = quality.fit(frame)
    kept = {r["doc_id"]: r["c"] for r in frame.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(quality.CALIBRATION_FOLDS)) == 0).alias("c")).collect()}
    mean = [sum(s[k] for s in stats) / 400 for k in range(quality.N_STATISTICS)]
    deviation = [math.sqrt(sum((s[k] - mean[k]) ** 2 for s in stats) / 400) for k in range(quality.N_STATISTICS)]
    draw = np.random.default_rng(quality.SEED)
    turn = draw.normal(0, 1 / (quality.WIDTH * np.sqrt(quality.N_STATISTICS)), (quality.N_STATISTICS, quality.FEATURES))
    phase = draw.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(s):
        z = [max(-8, min(8, (x - m) / d)) for x, m, d in zip(s, mean, deviation, strict=True)]
        return np.array([1.0] + [math.sqrt(2 / quality.FEATURES) * math.cos(sum(a * b for a, b in zip(z, turn[:, j], strict=True)) + phase[j]) for j in range(quality.FEATURES)])

    rows = [(features(stats[i]), labels[i]) for i in range(400) if not kept[i]]
    left = sum(np.outer(z, z) for z, _ in rows) + quality.RIDGE * len(rows) * np.eye(quality.FEATURES + 1)
    weights = np.linalg.solve(left, sum(z * y for z, y in rows))
    assert np.allclose(model.weights, weights, atol=1e-6)
    held = sorted((math.floor(float(features(stats[i]) @ weights) * quality.BINS), labels[i]) for i in range(400) if kept[i])
    levels = quality.isotonic(*(np.array(c, float) for c in zip(*[(sum(b == x for b, _ in held), sum(y for b, y in held if b == x)) for x in sorted({b for b, _ in held})], strict=True)))
    assert np.allclose(model.steps[1], levels) and (np.diff(levels) >= 0).all()


def test_isotonic_fit_is_the_best_non_decreasing_one():
    rng = np.random.default_rng(2)
    for _ in range(30):
        total = rng.integers(1, 5, 7).astype(float)
        positive = np.array([rng.integers(0, n + 1) for n in total], float)
        # the least of the largest means of runs that reach over each place
        best = [max(min(positive[a : b + 1].sum() / total[a : b + 1].sum() for b in range(k, 7)) for a in range(k + 1)) for k in range(7)]
        runs, out = [k for k in range(7) if k == 0 or not math.isclose(best[k], best[k - 1])] + [7], []
        for a, b in zip(runs, runs[1:], strict=False):
            out += [(positive[a:b].sum() + 0.5) / (total[a:b].sum() + 1)] * (b - a)
        assert np.allclose(quality.isotonic(total, positive), out)


def test_spectral_peaks_and_pairs():
    for payload in (b"", b"\0" * 64, bytes(range(256)) * 3, b"some words, and some more of them " * 30):
        samples = list(payload)
        n = max(1, math.ceil(max(0, len(samples) - media.FRAME) / media.HOP) + 1)
        samples += [128] * ((n - 1) * media.HOP + media.FRAME - len(samples))
        window = [0.5 - 0.5 * math.cos(2 * math.pi * k / (media.FRAME - 1)) for k in range(media.FRAME)]
        peaks = []
        for t in range(n):
            frame = [(samples[t * media.HOP + k] - 128) * window[k] for k in range(media.FRAME)]
            power = [abs(sum(x * complex(math.cos(a), math.sin(a)) for k, x in enumerate(frame) for a in [-2 * math.pi * b * k / media.FRAME])) for b in range(media.BANDS[-1][1])]
            peaks.append([[b for b in range(low, high) if power[b] >= max(power[low:high]) - 0.02] for low, high in media.BANDS])
        found = media.peaks(np.frombuffer(payload, np.uint8))
        assert len(found) == n
        assert all(bin_ in peaks[t][k] for t in range(n) for k, bin_ in enumerate(found[t].tolist()))
        pairs = sorted(t << 24 | int(found[t][k]) << 16 | int(found[t + gap][k]) << 8 | gap for gap in range(1, media.FAN_OUT + 1) for t in range(n - gap) for k in range(len(media.BANDS)))
        assert media.fingerprints(np.frombuffer(payload, np.uint8)).tolist() == pairs


def plain_text(html):
    return " ".join(" ".join(line[0] for line in html_extract.Page(html).lines if not line[2]).split())


def test_pages_do_not_depend_on_partitions(spark):
    shared = "<p>Menu of the host</p><p>Another shared line</p>"
    rows = [(k, f"http://h{k % 3}.example/{k // 7}/{k}", f"<body>{shared}<p>Own text {k} of some length, with words.</p><p>More of {k}.</p><p>Foot line</p></body>") for k in range(60)]
    rows += [(100, "http://alone.example/x", f"<body>{shared}<p>Alone.</p></body>"), (101, None, None), (102, "no host", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: f"Own text {k} of some length, with words. More of {k}." for k in range(60)} | {100: plain_text(rows[60][2]), 101: "", 102: "a"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_alignment_is_longest_and_bounded():
    rng = np.random.default_rng(1)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            done = [0]
            for j, y in enumerate(b):
                done.append(row[j] + 1 if x == y else max(row[j + 1], done[j]))
            row = done
        return row[-1]

    for _ in range(300):
        a, b = ([str(x) for x in rng.integers(0, 6, rng.integers(0, 15))] for _ in range(2))
        found = html_extract.shared_lines(a, b)
        rest = iter(b)
        assert len(found) == longest(a, b) and all(a[k] in rest for k in sorted(found))
    assert len(html_extract.shared_lines(["x"] * 50_000, ["x"] * 49_000)) == 49_000


def test_classes_that_only_resemble_others(spark):
    body = "<article><p>All of the text.</p></article>"
    rows = [(1, f'<body class="single no-sidebar">{body}</body>'), (2, f'<div class="search-results"><main>{body}</main></div>'), (3, '<article><div class="content has-share-buttons"><p>All of the text.</p></div></article>')]
    pages = spark.createDataFrame([(k, f"http://h{k}.example/", h) for k, h in rows], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract(pages).collect()} == {"All of the text."}


def test_token_files_are_in_ascending_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(7)
    path = shared_path(spark, "token-order")
    token_files.write(token_files.tokenize(docs), path)
    folder = path.removeprefix("file://") + "/blocks"
    found = []
    for slot in sorted(d for d in os.listdir(folder) if d.startswith("slot=")):
        files = sorted(f for f in os.listdir(f"{folder}/{slot}") if f.endswith(".parquet"))
        assert len(files) == 1
        for ids in pq.ParquetFile(f"{folder}/{slot}/{files[0]}").read(columns=["doc_ids"]).column(0).to_pylist():
            found += ids
    assert found == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_sentence_spans_with_ids_of_any_type(spark):
    passage = " ".join(f"word{i}" for i in range(30)) + ". " + " ".join(f"more{i}" for i in range(30)) + "."
    rows = [("b", passage + " Own words of b."), ("a", passage + " Own words of a."), (None, passage), ("c", passage + " One text of c."), ("c", passage + " Other text of c.")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    done = [(r["doc_id"], r["repeats"]["n_removed"]) for r in substring_dedup.deduplicate(df).collect()]
    assert sorted(done, key=str) == sorted([("b", 2), ("a", 2), (None, 0), ("c", 2), ("c", 2)], key=str)


def test_cycles_and_repeated_nodes_of_reply_trees(spark):
    rows = [(1, 1, 1, "own parent"), (1, 2, 1, "child"), (2, 1, 3, "cycle"), (2, 2, 1, "cycle"), (2, 3, 2, "cycle"), (2, 4, 3, "below"), (3, 1, None, "root"), (3, 2, 1, "twice"), (3, 2, 1, "twice again")]
    df = spark.createDataFrame([(t, n, p, "user", x, 1.0) for t, n, p, x in rows], "tree long, node long, parent long, role string, text string, score double")
    found = sorted((r["tree"], r["leaf"], r["node"], r["up"]) for r in chat.paths(df).collect())
    assert found == [(1, 2, 1, 1), (1, 2, 2, 0), (2, 4, 1, 3), (2, 4, 2, 2), (2, 4, 3, 1), (2, 4, 4, 0), (3, 2, 1, 1), (3, 2, 2, 0)]
    branches = {r["tree"]: [t["text"] for t in r["turns"]] for r in chat.ranked_branches(df).collect()}
    assert branches[3] == ["root", "twice", "twice again"] and branches[1] == ["own parent", "child"]


def test_components_of_a_thousand_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in rows.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_size = sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))
    for i, a in enumerate(by_size):
        for b in by_size[i + 1 :]:
            if 100 * len(sets[a]) < 75 * len(sets[b]):
                break
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(rows).collect()}
    assert got == {d: (len(sets[d]), find(d)) for d in sets}
    assert json.dumps(sorted(got))  # ids are plain integers
