"""Benchmark decontamination with DataFrame functions only.

The benchmark's normalised n-gram windows are hashed and, while few enough, broadcast; every window of
every text is looked up by hash, hits are verified word by word, and the hit words or whole documents go.

Nulls and ties: a null text has no words, an item without words has no window, an item with a null id counts
for hit words but is not named. Rows with the same id and text get the same result, one row for each input row.
Words of any script, texts of any length and empty tables are allowed; columns besides the id and text are
never read, so their names do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import apart, ascii_lower, bounded, materialize

#: A maximal run of 0-9, a-z and everything beyond ASCII, after lower-casing A-Z.
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
#: The same on text whose case is kept, with what stands before each word.
PIECE = r"[\x00-/:-@\[-`{-\x7F]*[0-9A-Za-z\x80-\x{10FFFF}]+|[\x00-/:-@\[-`{-\x7F]+$"
NGRAM = 10
#: Windows up to this number are broadcast: at some 250 bytes each, 50 MB. More are joined by shuffle.
BROADCAST_WINDOWS = 200_000
#: Stands for the hash of the window of no words that each text has.
NO_WINDOW = -1


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _at(array: Column, length: int) -> Column:
    """Hash of each window of so many words, by start."""
    last = F.size(array) - F.lit(length)
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(array, i + 1, length)))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _windows_at(array: Column, length: int) -> Column:
    """Hash and words of each window of so many words, by start."""
    last = F.size(array) - F.lit(length)
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.slice(array, i + 1, length)).alias("hash"), F.slice(array, i + 1, length).alias("words")))
    return F.when(last >= 0, each)


def benchmark_windows(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """(window_hash, n, window, items): the distinct windows with the ids of the items that hold them."""
    split = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    each = split.select("item", size.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice(F.col("w"), i, size))).alias("window"))
    return each.groupBy("n", "window").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.xxhash64("window").alias("window_hash"), "n", "window", "items")


def scan(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, text_hash, rows, n_words, positions, items) of each distinct document.

    rows: how often the document occurs; positions: of the hit words, from 0; items: those whose windows occur.
    The texts are read once for each length that windows have: one length, but for items of fewer than n words.
    While the windows are broadcast, each text also gives one row that matches a window of no words, so that none is
    lost. Where they are too many, each window of a text goes to the shuffle with its own words only, and the texts
    are read once more for those rows.
    """
    windows = benchmark_windows(benchmark, n)
    sizes = {r["n"]: r["count"] for r in windows.groupBy("n").count().collect()}  # n rows at most
    parts, few = [], sum(sizes.values()) <= broadcast_windows
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    if not few:
        whole = texts.select("doc_id", "text_hash", F.size("w").alias("words"), F.lit(None).cast("struct<pos:int,n:int>").alias("span"), F.lit(None).cast("array<string>").alias("items"))
        parts.append(whole)
    for k, length in enumerate(sorted(sizes) or [n]):
        if not few:
            own = windows.where(F.col("n") == length)
            at = texts.select("doc_id", "text_hash", F.posexplode(_windows_at(F.col("w"), length)).alias("pos", "found"))
            same = (at["found.hash"] == own["window_hash"]) & (at["found.words"] == own["window"])
            parts.append(at.join(own, same).select("doc_id", "text_hash", F.lit(None).cast("int").alias("words"), F.struct("pos", "n").alias("span"), "items"))
            continue
        own = windows.where(F.col("n") == length)
        if k == 0:
            own = own.unionByName(windows.sparkSession.sql(f"SELECT {NO_WINDOW} AS window_hash, 0 AS n, cast(array() AS array<string>) AS window, cast(NULL AS array<string>) AS items"))
        own = F.broadcast(own)
        hashes = _at(F.col("w"), length)
        at = texts.select("doc_id", "text_hash", "w", F.posexplode(F.concat(hashes, F.array(F.lit(NO_WINDOW)).cast("array<bigint>")) if k == 0 else hashes).alias("pos", "found"))
        same = (at["found"] == own["window_hash"]) & (F.slice(at["w"], at["pos"] + 1, own["n"]) == own["window"])
        span = F.when(F.col("n") > 0, F.struct("pos", "n"))
        parts.append(at.join(own, same).select("doc_id", "text_hash", F.when(F.col("n") == 0, F.size("w")).alias("words"), span.alias("span"), "items"))
    each = reduce(DataFrame.unionAll, parts).groupBy("doc_id", "text_hash")
    spans = each.agg(F.count("words").alias("rows"), F.max("words").cast("bigint").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1)))
    return spans.select("doc_id", "text_hash", "rows", "n_words", F.array_distinct(places).alias("positions"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def find_hits(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """(doc_id, text_hash, positions, items) of each distinct document in which a window occurs."""
    return scan(documents, benchmark, n).where(F.size("positions") > 0).select("doc_id", "text_hash", "positions", "items")


def _with_hits(documents: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    """documents joined with hits, whose columns (doc_id, text_hash, ..) are named apart from those of documents."""
    found = hits.toDF(*apart(documents, *(f"_{c}" for c in hits.columns)))
    id_, hash_ = (F.col(f"`{c}`") for c in found.columns[:2])
    return documents.join(found, documents["doc_id"].eqNullSafe(id_) & (F.xxhash64(documents["text"]) == hash_), how)


def report(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """One row for each document: how many words it has, how many are hit, and by which items."""
    found = scan(documents, benchmark, n).select("*", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_row"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("positions").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("positions") > 0).alias("contaminated"),
    )


def remove_documents(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """The documents without any hit, all columns kept."""
    hits = materialize(find_hits(documents, benchmark, n).select("doc_id", "text_hash"), "contaminated")
    return _with_hits(documents, bounded(hits), "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """All documents and columns; hit words, each with what stands between it and the word before, are cut from the text."""
    both = _with_hits(documents, find_hits(documents, benchmark, n).select("doc_id", "text_hash", "positions"), "left")
    pieces = F.regexp_extract_all(documents["text"], F.lit(PIECE), F.lit(0))
    positions = F.col(apart(documents, "_positions")[0])
    kept = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(positions, i)), "")
    text = F.when(positions.isNull(), documents["text"]).otherwise(kept).alias("text")
    return both.select(*[text if c == "text" else documents[c] for c in documents.columns])


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, w[p:p + n - 1] AS win FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, w[p:p + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, p, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
