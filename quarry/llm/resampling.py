"""Importance resampling towards the word distribution of a target.

Features are runs of consecutive words. Each distinct feature is brought together from the whole corpus and hashed once,
buckets sum the counts of their features, and the gain of a bucket, the logarithm of how much likelier the target is to
hold it, goes back to the documents that hold the bucket's features. Gumbel noise drawn from the id turns weights into
scores, of which the greatest are drawn without replacement.

Frequent features never meet in a shuffle. Each chunk of the corpus names those that make up a SHARE-th part of it or
more; what none names makes up less of the whole. The HOT most frequent of these are hashed once on the driver, and their
counts stay with their documents. All other features go, as rows of feature, document and count, to the task that hashes
them, which drops the string.

Nulls and ties: a null or empty text has no words, weighs 0 and is not drawn. A null id draws the noise of the empty
string and comes last among equal scores. Every row is judged for itself; rows with the same id and text get the same
score and ranks in a row. Empty tables give empty results; an empty target gives no feature an advantage beyond its
smoothing. Columns other than the id and text are not read, so their names do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, bounded, discard, map_arrow, materialize, slices

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: The part of a chunk that a feature makes up to be named, features of a chunk, and features that are kept as frequent.
SHARE, CHUNK, HOT = 10_000, 300_000, 100_000
#: Bytes of text that are split into words at a time, rows that a task hands on at a time.
PIECE, ROWS = 1 << 20, 50_000

#: A byte as it stands in words: A-Z as a-z; what is neither letter, digit nor beyond ASCII is a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def counts(text: str | None, lo: int, hi: int) -> tuple[int, Counter]:
    """How many words a text has, and its features, as UTF-8, with their counts."""
    data, at, n, before, found = (text or "").encode().translate(_FOLD), 0, 0, [], Counter()
    while at < len(data):
        cut = data.find(b" ", at + PIECE)
        end = cut if cut >= 0 else len(data)
        own = data[at:end].split()
        n, at = n + len(own), end
        for size in range(lo, hi + 1):
            words = before[max(0, len(before) - size + 1) :] + own if size > 1 else own
            found.update(words if size == 1 else (b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)))
        before = (before + own)[-(hi - 1) :] if hi > 1 else []
    return n, found


def frequent(documents: DataFrame, lo: int, hi: int) -> dict[bytes, int]:
    """The most frequent features, HOT at most, with crc32: all that make up a SHARE-th part of the corpus are among those named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named() -> pa.RecordBatch:
            least = sum(chunk.values()) / SHARE
            kept = [(f, n) for f, n in chunk.items() if n >= least and n > 1]
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["feature", "n"])

        chunk: Counter = Counter()
        for batch in batches:
            for cut in slices(batch):
                for text in cut.column("text"):
                    chunk.update(counts(text.as_py(), lo, hi)[1])
                if len(chunk) > CHUNK:
                    yield named()
                    chunk.clear()
        yield named()

    found = map_arrow(documents.select("text"), run, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return {bytes(r["feature"]): zlib.crc32(r["feature"]) for r in found.orderBy(F.desc("n"), "feature").limit(HOT).collect()}


def counted(documents: DataFrame, hot: dict[bytes, int], lo: int, hi: int, buckets: int) -> DataFrame:
    """Rows of two kinds: (feature, n, row), a rare feature of a document, and one with feature null for each document.

    The latter has doc_id, text_hash, n_words, n_features, and its frequent features by bucket: hot_buckets, hot_counts.
    """
    known = documents.sparkSession.sparkContext.broadcast({f: h % buckets for f, h in hot.items()})
    kind = documents.schema["doc_id"].dataType.simpleString()
    place = "row long, doc_id " + kind + ", text_hash long, n_words long, n_features long, hot_buckets array<int>, hot_counts array<long>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32()), pa.list_(pa.int64())

        def documents_of(cut: pa.RecordBatch, told: list[tuple]) -> pa.RecordBatch:
            n_words, n_features, own, of = zip(*told, strict=True)
            none = pa.nulls(len(told), pa.binary()), pa.nulls(len(told), pa.int64())
            return pa.RecordBatch.from_arrays([none[0], none[1], cut.column("row"), cut.column("doc_id"), cut.column("text_hash"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(own, ints[0]), pa.array(of, ints[1])], names)

        def features_of(rows: list[int], features: list[bytes], ns: list[int]) -> pa.RecordBatch:
            null = [pa.nulls(len(rows), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), *ints)]
            return pa.RecordBatch.from_arrays([pa.array(features, pa.binary()), pa.array(ns, pa.int64()), pa.array(rows, pa.int64()), *null], names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for cut in slices(batch):
                told, rows, features, ns = [], [], [], []
                for row, text in zip(cut.column("row").to_pylist(), cut.column("text"), strict=True):
                    n_words, found = counts(text.as_py(), lo, hi)
                    sums: Counter = Counter()
                    for feature, n in found.items():
                        bucket = known.value.get(feature)
                        if bucket is None:
                            rows.append(row)
                            features.append(feature)
                            ns.append(n)
                        else:
                            sums[bucket] += n
                    told.append((n_words, sum(found.values()), list(sums), list(sums.values())))
                    if len(rows) >= ROWS:
                        yield features_of(rows, features, ns)
                        rows, features, ns = [], [], []
                if told:
                    yield documents_of(cut, told)
                if rows:
                    yield features_of(rows, features, ns)

    names = ["feature", "n", *(c.split()[0] for c in place.split(", "))]
    docs = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(docs, split, "feature binary, n long, " + place)


def hashed(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, row) of the rare features among rows as counted() gives them: dealt by feature, in order, each string is hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("feature").dictionary_encode()
            codes = pa.array([zlib.crc32(f) % buckets for f in own.dictionary.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([codes.take(own.indices), batch.column("n"), batch.column("row")], ["bucket", "n", "row"])

    # three plain columns: Arrow batches of bounded bytes are costly to fill with wide rows
    together = rows.where("feature IS NOT NULL").select("feature", "n", "row").repartition("feature").sortWithinPartitions("feature")
    return map_arrow(together, run, "bucket int, n long, row long")


def weights(documents: DataFrame, target: DataFrame, lo: int = 1, hi: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, text_hash, n_words, n_features, weight) of each row of documents; the table is written."""
    rows = materialize(counted(documents, frequent(documents, lo, hi), lo, hi, buckets), "importance-rows")
    rare = materialize(hashed(rows, buckets), "importance-hashed")
    known = rows.where("feature IS NULL")
    frequent_ones = known.select("row", F.explode(F.arrays_zip("hot_buckets", "hot_counts")).alias("h")).select(F.col("h.hot_buckets").alias("bucket"), F.col("h.hot_counts").alias("n"), "row")
    each = rare.unionByName(frequent_ones)
    wanted = hashed(counted(target.select(F.lit(0).alias("doc_id"), "text"), {}, lo, hi, buckets), buckets).groupBy("bucket").agg(F.sum("n").alias("t"))
    source = each.groupBy("bucket").agg(F.sum("n").alias("s"))
    sums = materialize(source.join(wanted, "bucket", "full_outer").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "importance-buckets")
    all_source, all_wanted = (x or 0 for x in sums.agg(F.sum("s"), F.sum("t")).first())
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float(all_source + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(all_wanted + buckets)))
    gains = F.broadcast(sums.select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain")))  # a row for each bucket at most
    named = known.select("row", "doc_id", "text_hash", "n_words", "n_features", F.lit(0).cast("long").alias("weight"))
    none = [F.lit(None).cast(t).alias(c) for c, t in named.dtypes[1:5]]
    both = named.unionByName(each.join(gains, "bucket").select("row", *none, (F.col("n") * F.col("gain")).alias("weight")))
    found = both.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "text_hash", "n_words", "n_features")], F.sum("weight").alias("weight"))
    told = materialize(found, "importance-weights")
    discard(rows, rare, sums)
    return told


def scores(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """weighted with the column score: weight and Gumbel noise in thousandths, drawn from the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("bigint")
    return weighted.withColumn("score", F.col("weight") + noise)


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with the column rank of those drawn: the given share of rows with so many words, the greatest scores first.

    Rows are sorted in ranges and counted by range, so no task sees more than its range.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    able = scored.where(F.col("n_words") >= least_words)
    ranges = materialize(able.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "importance-ranges")
    starts, at = [], 0
    for part, n in ranges.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each range
        starts.append((part, at))
        at += n
    before = F.broadcast(scored.sparkSession.createDataFrame(starts, "part int, before bigint"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    placed = ranges.join(before, "part").withColumn("rank", place)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.withColumn("rank", F.when(F.col("rank") <= at * percent // 100, F.col("rank"))).select(*rest.columns).unionByName(rest)


def resample(documents: DataFrame, target: DataFrame, lo: int = 1, hi: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(row, doc_id, text_hash, n_words, n_features, weight, score, rank) of each row; row numbers it and means nothing else."""
    return ranked(scores(weights(documents, target, lo, hi, buckets), seed), percent, least_words)


def draw(documents: DataFrame, result: DataFrame) -> DataFrame:
    """The drawn documents with all their columns, by resample()'s result.

    Of rows with the same id and text as many are taken as were drawn; only the group at the border can be cut.
    """
    name = "_drawn"
    while name in documents.columns:
        name += "_"
    groups = materialize(result.groupBy("doc_id", "text_hash").agg(F.count("rank").alias("drawn"), F.count("*").alias("rows")).where("drawn > 0"), "importance-drawn")
    key = F.struct("doc_id", F.xxhash64("text"))
    whole = bounded(groups.where("drawn = rows").select(F.struct("doc_id", "text_hash").alias(name)))
    taken = documents.join(whole, key.eqNullSafe(F.col(name)), "left_semi")
    cut = groups.where("drawn < rows").first()
    if cut is None:
        return taken
    same = F.col("doc_id").eqNullSafe(F.lit(cut["doc_id"])) & (F.xxhash64("text") == cut["text_hash"])
    return taken.unionByName(documents.where(same).limit(cut["drawn"]))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: CRC32, bit by bit, of the bytes of the string w.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::INT, 2))::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}')) AS w FROM benchmark),
counts AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, count(*) AS s, 0 AS t FROM dw GROUP BY w UNION ALL SELECT w, 0, count(*) FROM bw GROUP BY w) GROUP BY w),
dict AS (SELECT w, s, t, {_CRC32} % {BUCKETS} AS bucket FROM counts),
sums AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM dict GROUP BY bucket),
totals AS (SELECT sum(s) AS source, sum(t) AS wanted FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (source + {BUCKETS}) / ((s + 1) * (wanted + {BUCKETS})))) AS BIGINT) AS gain FROM sums, totals),
weighed AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN dict USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN k <= n * {PERCENT} // 100 THEN k END AS BIGINT) AS rank FROM scored LEFT JOIN placed USING (r)
"""
