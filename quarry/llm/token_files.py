"""Token ids of a corpus in compressed files: canonical length-limited Huffman codes from global counts.

Documents are put in ascending doc_id order by range partitioning, tokenized once, and the ids kept; their counts
over the whole corpus give one code; blocks of whole documents are coded independently, each with its documents' ids
and sizes and a bit offset every STRIDE ids, and decoded with one table.

Nulls and ties: a null text is empty, so its document holds the end id alone; a null doc_id comes first, and rows of
one doc_id follow each other by text. Texts of any length are whole: one document is never split over blocks. Empty
tables give files without blocks. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import huffman
from quarry.llm.common import discard, map_arrow, materialize, shared_path, short_reads, slices
from quarry.llm.tokens import END_ID, encoder

#: A block is closed once it holds so many ids.
BLOCK_IDS = 1 << 16
_END = np.array([END_ID], "<u2")
_BLOCKS = "part int, before long, doc_ids array<{}>, sizes array<long>, checkpoints array<long>, bits binary"


def tokenize(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(part, before, doc_id, n_tokens, ids) by ascending doc_id; before: ids of the part's earlier documents; ids: 16-bit."""
    docs = short_reads(documents).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            for cut in slices(batch):
                ids = [np.append(x, _END) for x in encode(cut.column("text"))]
                sizes = np.array([len(x) for x in ids], np.int64)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), cut.column("doc_id"), pa.array(sizes), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())],
                    ["part", "before", "doc_id", "n_tokens", "ids"],
                )

    return map_arrow(docs, run, f"part int, before long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs, over all documents; what reaches the driver is at most one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for row in map_arrow(tokens.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def write(tokens: DataFrame, path: str) -> None:
    """Writes path/code (length of each id's code), path/parts (ids in each part) and path/blocks.

    The blocks of each part are one file in a folder of its own; folders in order of name, and blocks in order within
    a file, hold the documents by ascending doc_id.
    """
    spark = tokens.sparkSession
    lengths = huffman.code_lengths(count_ids(tokens))
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    tokens.groupBy("part").agg(F.sum("n_tokens").alias("n_ids")).coalesce(1).write.parquet(f"{path}/parts")
    sent = spark.sparkContext.broadcast((huffman.canonical(lengths)[0], lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = sent.value

        def block(rows: list[tuple]) -> pa.RecordBatch:
            bits, marks = huffman.encode(np.frombuffer(b"".join(r[4] for r in rows), "<u2"), codes, sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[0][0]], pa.int32()), pa.array([rows[0][1]], pa.int64()), pa.array([[r[2] for r in rows]], pa.list_(id_type)), pa.array([[r[3] for r in rows]], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
                ["part", "before", "doc_ids", "sizes", "checkpoints", "bits"],
            )

        rows, held, id_type = [], 0, pa.int64()
        for batch in batches:
            id_type = batch.column("doc_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (held >= BLOCK_IDS or row[0] != rows[-1][0] or row[1] != rows[-1][1] + rows[-1][3]):
                    yield block(rows)
                    rows, held = [], 0
                rows.append(row)
                held += row[3]
        if rows:
            yield block(rows)

    kind = tokens.schema["doc_id"].dataType.simpleString()
    blocks = map_arrow(tokens.select("part", "before", "doc_id", "n_tokens", "ids"), run, _BLOCKS.format(kind))
    ordered = blocks.withColumn("slot", F.format_string("%06d", "part")).repartition("slot").sortWithinPartitions("slot", "before")
    ordered.write.partitionBy("slot").parquet(f"{path}/blocks")
    tokens.limit(0).select("doc_id").write.parquet(f"{path}/kind")
    sent.unpersist()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files."""
    lengths = np.zeros(1 << 16, np.uint8)
    for row in spark.read.parquet(f"{path}/code").collect():  # at most one row for each id
        lengths[row["id"]] = row["length"]
    sent = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(_BLOCKS.format(spark.read.parquet(f"{path}/kind").schema["doc_id"].dataType.simpleString())).parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, symbols, steps = huffman.canonical(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                cut = batch.slice(at, 16)
                part, before, docs, sizes, marks, bits = (cut.column(c).to_pylist() for c in ("part", "before", "doc_ids", "sizes", "checkpoints", "bits"))
                ids = huffman.decode(bits, [np.array(m, np.int64) for m in marks], [sum(s) for s in sizes], symbols, steps)
                rows = []
                for p, b, d, s, x in zip(part, before, docs, sizes, ids, strict=True):
                    x = x.astype("<u4")
                    for doc, size, end in zip(d, s, np.cumsum(s).tolist(), strict=True):
                        own = x[end - size : end].tobytes()
                        rows.append((p, b + end - size, doc, size, zlib.crc32(own), own))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema(batch))

    names = ["part", "before", "doc_id", "n_tokens", "ids_crc32", "ids"]

    def schema(batch: pa.RecordBatch) -> pa.Schema:
        return pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_id", batch.column("doc_ids").type.value_type), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    found = map_arrow(short_reads(blocks), run, f"part int, before long, doc_id {kind}, n_tokens long, ids_crc32 long, ids binary")
    parts = spark.read.parquet(f"{path}/parts")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    starts = parts.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("first"))
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def round_trip(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the documents' ids to a new folder of files and returns what read() finds there."""
    spark = documents.sparkSession
    path = shared_path(spark, "token-files")
    tokens = materialize(tokenize(documents, vocabulary), "token-ids")
    write(tokens, path)
    discard(tokens)
    return read(spark, path)
