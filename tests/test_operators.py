import datetime as dt
import random
import pytest
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quarry.functions import dates, text
from quarry.operators import changes, graph, matching, relational, temporal
from quarry.plans import catalogue, matching as plans

D = dt.date


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_change_points_without_blips_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(p, i, rng.choice("AAB")) for p in range(20) for i in range(30)]
    df = spark.createDataFrame(rows, "person int, at int, state string")
    want = []
    for p in range(20):
        states = [s for q, _, s in rows if q == p]
        last = None
        for k, s in enumerate(states):
            if last is None or (s != last and not (k + 1 < len(states) and states[k + 1] == last)):
                want.append((p, k, s))
                last = s
    assert values(temporal.change_points_without_blips(df, "person", "at", "state"), "person", "at", "state") == sorted(want, key=str)


@pytest.mark.parametrize("walked", [10_000, 0])
def test_greedy_pairs_against_a_loop(spark, sf, monkeypatch, walked):
    monkeypatch.setattr(matching, "WALKED", walked)
    scored = [tuple(r) for r in plans._scored(spark, sf).collect()]
    want, used = [], set()
    for g, a, b, s in sorted(scored, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if (g, "a", a) not in used and (g, "b", b) not in used:
            used |= {(g, "a", a), (g, "b", b)}
            want.append((g, a, b, s))
    assert values(catalogue.QUERIES["bipartite_match"](spark, sf), "grp", "left", "right", "score") == sorted(want, key=str)


def test_clusters_never_hold_two_of_one_time(spark, sf):
    found = {r["id"]: r["cluster"] for r in catalogue.QUERIES["fuzzy_cluster"](spark, sf).collect()}
    rows = {r["p_partkey"]: r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    assert set(found) == set(rows)
    name = lambda r: f"{r['p_name']} {r['p_size'] % 5}"
    for i, c in found.items():
        assert (rows[i]["p_brand"], rows[i]["p_type"]) == (rows[c]["p_brand"], rows[c]["p_type"])
    for i in rows:
        for j in rows:
            if i < j and (rows[i]["p_brand"], rows[i]["p_type"]) == (rows[j]["p_brand"], rows[j]["p_type"]) and name(rows[i]) == name(rows[j]):
                assert found[i] == found[j]


def _clusters_by_loop(rows, least=0.84):
    """(id, cluster) of rows (block, id, name, seen), every two names of a block compared."""
    out = {}
    for block in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == block), key=lambda r: r[1])
        head, seen = {}, {}
        for _, i, name, at in own:
            head.setdefault(name, i)
            seen.setdefault(head[name], set()).update(at)
        root = {h: h for h in seen}
        edges = [(-r, x, y) for m, x in head.items() for n, y in head.items() if x < y and (r := SequenceMatcher(None, m, n).ratio()) >= least]
        for _, x, y in sorted(edges):
            x, y = sorted((root[x], root[y]))
            if x != y and not seen[x] & seen[y]:
                seen[x] |= seen[y]
                root = {h: x if c == y else c for h, c in root.items()}
        out |= {i: root[head[name]] for _, i, name, _ in own}
    return out


def test_clusters_against_a_loop(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    rows = [(f"{r['p_brand']}", r["p_partkey"], f"{r['p_name']} {r['p_size'] % 5}", [r["p_partkey"] % 11]) for r in parts]
    rows += [("k", 90001, "ab", [1]), ("k", 90002, "a", [2]), ("k", 90003, "", [3]), ("k", 90004, "abcdefg", [4]), ("k", 90005, "abcxdefg", [5]), ("k", 90006, "abcxdefgh", [4]), ("k", 90007, "abcxdefgh", [])]
    df = spark.createDataFrame(rows, "block string, id long, name string, seen array<int>")
    found = matching.constrained_clusters(df, "block", "id", "name", "seen")
    assert {r["id"]: r["cluster"] for r in found.collect()} == _clusters_by_loop(rows)


def test_clusters_of_nulls_and_no_rows(spark):
    kind = "block string, id long, name string, seen array<int>"
    df = spark.createDataFrame([(None, 1, "abc", [1]), (None, 2, "abc", [1]), ("k", 3, None, [1]), ("k", 4, "abc", None), ("k", 5, "abc", [2])], kind)
    found = {r["id"]: r["cluster"] for r in matching.constrained_clusters(df, "block", "id", "name", "seen").collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    assert matching.constrained_clusters(df.limit(0), "block", "id", "name", "seen").count() == 0


def test_greedy_pairs_of_ties_repeats_and_nulls(spark):
    kind = "g string, l int, r int, s double"
    rows = [("a", x, y, 1.0) for x in range(5) for y in range(4)] + [("a", 1, 3, 2.0), ("b", 1, 1, None), ("b", 1, 2, 0.5), (None, 1, 1, 1.0)]
    found = matching.greedy_pairs(spark.createDataFrame(rows, kind), "g", "l", "r", "s")
    assert values(found, "g", "l", "r", "s") == sorted([("a", 1, 3, 2.0), ("a", 0, 0, 1.0), ("a", 2, 1, 1.0), ("a", 3, 2, 1.0), ("b", 1, 2, 0.5)], key=str)
    assert matching.greedy_pairs(spark.createDataFrame([], kind), "g", "l", "r", "s").count() == 0


def test_similarity(spark):
    df = spark.createDataFrame([("ab", "abc"), ("abcd", "xabcd"), ("abc", "xyz"), ("", "q")], "a string, b string")
    got = [r[0] for r in df.select(matching.similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[2] == 0.0 and got[3] == 1.0
    assert abs(got[1] - min(1, SequenceMatcher(None, "abcd", "xabcd").ratio() + 0.35)) < 1e-12


def test_components_of_a_long_path_and_empty_graph(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = dict(values(graph.components(path), "node", "root"))
    assert set(got[i] for i in range(301)) == {0} and got[1001] == 1000
    assert graph.components(path.where("false")).collect() == []


def test_near_spellings_finds_every_pair(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(80)})
    df = spark.createDataFrame([(w, w) for w in words], "k string, s string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for distance in (1, 2):
        want = sorted(((a, b, edits(a, b)) for a in words for b in words if a < b and edits(a, b) <= distance), key=str)
        assert values(matching.near_spellings(df, "k", "s", distance), "a", "b", "edits") == want


def test_as_of_fallbacks(spark):
    probes = spark.createDataFrame([(1, D(2020, 1, 1)), (1, D(2021, 6, 1)), (2, D(2020, 1, 1))], "p int, day date")
    versions = spark.createDataFrame([(1, D(2021, 1, 1), "a"), (1, D(2022, 1, 1), "b")], "p int, since date, v string")
    get = lambda f: [r[2] for r in values(temporal.as_of(probes, versions, "p", "day", "since", f), "p", "day", "v")]
    assert get("earliest") == ["a", "a", None]
    assert get("newest") == ["b", "a", None]
    assert get(None) == [None, "a", None]


def test_islands_and_splits(spark):
    df = spark.createDataFrame([(1, 1, D(2020, 1, 1), D(2020, 1, 5)), (1, 2, D(2020, 1, 6), D(2020, 1, 7)), (1, 3, D(2020, 1, 9), D(2020, 1, 9))], "p int, id int, s date, e date")
    assert values(temporal.merge_islands(df, ["p"]), "s", "e", "parts") == [(D(2020, 1, 1), D(2020, 1, 7), 2), (D(2020, 1, 9), D(2020, 1, 9), 1)]
    busy = spark.createDataFrame([(1, D(2020, 1, 3))], "p int, day date")
    assert (1, D(2020, 1, 4), D(2020, 1, 5)) in values(temporal.split_on_days(df, busy, "p", "id"), "id", "s", "e")


def _dated(seed, n):
    """Rows (owner, key, first, last): one owner has most of them; some lack an owner or a bound, some are reversed."""
    draw = random.Random(seed)
    day = lambda: None if draw.random() < 0.05 else D(2019, 11, 1) + dt.timedelta(draw.randrange(160))
    rows = []
    for k in range(n):
        first = day()
        last = day() if draw.random() < 0.1 else first and first + dt.timedelta(draw.choice([0, 1, 5, 40, 90]))
        rows.append((draw.choice([1, 1, 1, 2, 3, None]), k, first, last))
    return rows


def test_interval_joins_against_loops(spark):
    held, asked = _dated(1, 60), _dated(2, 60)
    intervals = spark.createDataFrame([*held, (1, 60, D(2020, 1, 1), D(9999, 12, 31))], "p int, id int, s date, e date")
    points = spark.createDataFrame([(o, k, d) for o, k, d, _ in asked], "p int, at int, day date")
    held = [*held, (1, 60, D(2020, 1, 1), D(9999, 12, 31))]
    for open_end in (False, True):
        inside = lambda d, s, e: d and s and s <= d and (d <= e if e else open_end)  # noqa: B023, E731
        want = [(k, i) for o, k, d, _ in asked for p, i, s, e in held if o is not None and o == p and inside(d, s, e)]
        assert want and values(temporal.point_in_interval(points, intervals, "p", "day", open_end=open_end), "at", "id") == sorted(want, key=str)
    good = [r for r in held if r[0] is not None and r[2] and r[3] and r[2] <= r[3]]
    want = [(a[1], b[1]) for a in good for b in good if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3]]
    assert want and values(temporal.overlapping_pairs(intervals, "p", "id"), "key_a", "key_b") == sorted(want, key=str)
    empty = intervals.limit(0)
    assert temporal.point_in_interval(points, empty, "p", "day").isEmpty() and temporal.overlapping_pairs(empty, "p", "id").isEmpty()
    assert temporal.point_in_interval(points.limit(0), intervals, "p", "day").isEmpty()


def test_as_of_against_a_loop(spark):
    held, asked = _dated(3, 80), _dated(4, 80)
    versions = spark.createDataFrame([(o, k, d) for o, k, d, _ in held], "p int, v int, since date")
    probes = spark.createDataFrame([(o, k, d) for o, k, d, _ in asked], "p int, at int, day date")
    for fallback, pick in ((None, None), ("earliest", min), ("newest", max)):
        want = []
        for o, k, d, _ in asked:
            known = [(s, v) for p, v, s, _ in held if o is not None and o == p and s] if d else []
            before = [x for x in known if x[0] <= d]
            found = max(before) if before else pick(known) if pick and known else (None, None)
            want.append((k, found[1], found[0]))
        assert values(temporal.as_of(probes, versions, "p", "day", "since", fallback), "at", "v", "since") == sorted(want, key=str)
    assert temporal.as_of(probes, versions.limit(0), "p", "day", "since", "newest").where("v IS NULL").count() == 80


def test_split_on_days_against_a_loop(spark):
    held = [(o, k % 40, s, e) for o, k, s, e in _dated(5, 50)]
    cuts = [(o, d) for o, _, d, _ in _dated(6, 40)]
    intervals, busy = spark.createDataFrame(held, "p int, id int, s date, e date"), spark.createDataFrame(cuts, "p int, day date")
    want, left = set(), {}
    for o, k, s, e in held:
        for n in range((e - s).days + 1 if s and e else 0):
            if o is None or (o, s + dt.timedelta(n)) not in cuts:
                left.setdefault((o, k), set()).add(s + dt.timedelta(n))
    for (o, k), days in left.items():
        for d in sorted(days):
            if d - dt.timedelta(1) not in days:
                last = d
                while last + dt.timedelta(1) in days:
                    last += dt.timedelta(1)
                want.add((o, k, d, last, (last - d).days + 1))
    got = values(temporal.split_on_days(intervals, busy, "p", "id"), "p", "id", "s", "e", "days")
    assert got == sorted(want, key=str)


def test_carry_forward_blank_cuts(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), "x"), (1, D(2020, 1, 2), None), (1, D(2020, 1, 3), ""), (1, D(2020, 1, 4), None), (1, D(2020, 3, 1), None)], "p int, day date, f string")
    assert [r[1] for r in values(temporal.carry_forward(df, "p", "day", ["f"], 31), "day", "f_carried")] == ["x", "x", None, None, None]


def test_three_way_decisions(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, f string")
    got = changes.three_way(make([(1, "o"), (2, "o"), (3, "o"), (4, "o")]), make([(1, "n"), (2, "n"), (3, "o"), (4, "n"), (5, "n")]), make([(1, "o"), (2, "user"), (3, "o"), (4, "n")]), ["id"], ["f"])
    assert values(got, "id", "decision", "value") == [(1, "correct", "n"), (2, "protected", "user"), (4, "same", "n"), (5, "deleted", None)]


def test_allocate_ids_keeps_known_ones(spark):
    rows = spark.createDataFrame([("c",), ("a",), ("b",), ("a",)], "k string")
    known = spark.createDataFrame([("b", 7)], "k string, id long")
    assert values(relational.allocate_ids(rows, known, ["k"], "id", ["k"]), "k", "id") == [("a", 8), ("a", 8), ("b", 7), ("c", 9)]


def test_text_functions(spark):
    row = spark.createDataFrame([("أحمد  عبد الله، ٣", "at 5", "12:30 am", "25:00", "3 guards, 2 drivers", "call 0101-2345678 0101 2345678")], "a string, b string, c string, d string, e string, f string").select(
        text.fold(F.col("a")), text.name_key(F.col("a")), text.clock(F.col("b")), text.clock(F.col("c")), text.clock(F.col("d")), text.counted_classes(F.col("e")), text.phones(F.lit("x 01012345678, 0101-2345678"))
    ).first()
    assert row[0] == "احمد عبد الله 3" and row[1] == "احمد عبدالله 3"
    assert (row[2], row[3], row[4]) == ("17:00", "00:30", "")
    assert [tuple(x) for x in row[5]] == [(3, "guards"), (2, "drivers")]
    assert row[6] == ["01012345678"]


def test_dates(spark):
    row = spark.range(1).select(dates.canonical_day(F.lit("2024-2-3")), dates.canonical_day(F.lit("20240203")), dates.canonical_day(F.lit("2024-02-31")), dates.weekday_name(F.lit("2024-02-03").cast("date")), dates.next_weekday(F.lit("2024-02-03").cast("date"), F.lit(0))).first()
    assert (row[0], row[1], row[2], row[3], row[4]) == (None, "2024-02-03", None, "السبت", D(2024, 2, 10))


def test_places_in_groups_over_ranges(spark):
    from pyspark.sql import functions as F

    from quarry.operators import relational

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [("a", k * 7 % 101, None) for k in range(101)] + [("b", 1, None), (None, 2, None), (None, 1, None)]
    df = spark.createDataFrame(rows, "g string, v int, x string")
    got = sorted(((r["g"] or "", r["v"], r["place"], r["n"]) for r in relational.numbered_in_groups(df, ["g"], [F.desc("v")], "place", "n").collect()))
    assert got == sorted([("a", v, 101 - v, 101) for v in range(101)] + [("b", 1, 1, 1), ("", 2, 1, 2), ("", 1, 2, 2)])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_periods_keep_the_greatest_id_however_rows_come(spark):
    for ids in ([1, 2, 3], [3, 2, 1], [2, 3, 1]):
        rows = spark.createDataFrame([(k, "a", D(2020, 1, 1), D(2020, 1, 5)) for k in ids] + [(9, "a", D(2020, 1, 4), D(2020, 1, 4))], "id long, person string, s date, e date").coalesce(1)
        assert values(temporal.close_periods(rows, "person", ties=["id"]), "id", "e") == [(3, D(2020, 1, 3)), (9, D(2020, 1, 4))]


def test_pairs_are_scored_once_for_each_two_texts(spark, monkeypatch):
    monkeypatch.setattr(matching, "TOGETHER", 3)
    scored, plain = [], matching.written

    def counted(df, name):
        out = plain(df, name)
        if name == "scores":
            scored.append(out.count())
        return out

    monkeypatch.setattr(matching, "written", counted)
    rows = [(k, "g" if k % 5 else "h", None if k % 7 == 0 else f"t{k % 2}") for k in range(40)] + [(99, None, "t0")]
    left = spark.createDataFrame(rows, "a long, g string, x string")
    right = left.toDF("b", "g", "y")
    got = sorted(tuple(r) for r in matching.scored_pairs(left, right, ["g"], lambda x, y: F.struct(x.eqNullSafe(y).alias("same")), ["same"]).collect())
    assert got == sorted((a, b, x == y) for a, g, x in rows for b, h, y in rows if g is not None and g == h)
    assert scored == [9]


def test_links_of_sets_are_no_more_than_their_members(spark):
    rows = [(k, "g" if k < 150 else "h", [k % 3, 3 + k % 5] if k % 10 else [100 + k]) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, people array<long>")
    links = relational.links_of_sets(df, ["g"], "id", "people")
    every = relational.overlapping_sets(df, ["g"], "id", "people").selectExpr("a_key AS a", "b_key AS b")
    assert values(graph.components(links), "node", "root") == values(graph.components(every), "node", "root")
    assert links.count() <= sum(len(p) for _, _, p in rows) < every.count()
