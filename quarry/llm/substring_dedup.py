"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences; spans of consecutive sentences are hashed and compared over the whole corpus, and every
sentence that lies in a span which occurred before goes. Spans are as short as they can be: from each sentence
onward, and from each back, until they hold MIN_SENTENCES sentences and MIN_WORDS words. So a repeated passage of
twice MIN_WORDS words or more, cut at sentence ends, is covered whole. One sentence of twice MIN_WORDS is a span too.

The first occurrence is the one with the smallest doc_id, then the least hash of the text, then the earliest sentence;
it stays. Spans are compared by a 64-bit hash of their words (A-Z lower-cased, split at ASCII white space).

Nulls and ties: a null or empty text has no sentences and stays as it is. Ids of any type that can be ordered do; a null
doc_id comes first. Rows that repeat
a doc_id with the same text are one document: each keeps what that document keeps. A null is no id, so rows with a
null doc_id are a document each, and of those with the same text one counts as the first. Texts of any length are used
whole. All columns of the input are kept; names do not matter beyond doc_id and text. Empty tables stay empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import apart, give_back, in_batches, map_arrow, materialize, slices

MIN_WORDS, MIN_SENTENCES = 25, 2
#: What ends a sentence: . ! or ? and the white space behind it, or line feeds.
SENTENCE_END = re.compile(r"[.!?]\s+|\n+")
#: Bytes of text worked on at a time.
SLICE = 1 << 20


def sentences(text: str) -> list[str]:
    """The text in parts that join to it again."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True) if b > a]


def spans(words: list[int], min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each span, given the number of words of each sentence; end is one past the last."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    first = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + min_words), first + min_sentences)
    back = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, first + 1 - min_sentences)
    onward, backward = end <= n, back >= 0
    alone = np.flatnonzero(np.asarray(words) >= 2 * min_words)
    # end and start of every kind, each pair once
    pairs = np.concatenate([first[onward] * (n + 1) + end[onward], back[backward] * (n + 1) + first[backward] + 1, alone * (n + 1) + alone + 1])
    pairs = np.unique(pairs)
    return pairs // (n + 1), pairs % (n + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: A sequence's hash is the sum of its members' hashes times powers of this odd number, so sums of runs can be taken
#: from running sums; _INVERSE undoes a power.
_STEP = 0x9E3779B97F4A7C15
_INVERSE = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(parts: list[str], min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, end) of each span of these sentences; sentences without words belong to no span's ends."""
    split = [p.encode().lower().split() for p in parts]
    count = np.fromiter(map(len, split), np.int64, len(split))
    full = np.flatnonzero(count)
    first, end = spans(count[full], min_words, min_sentences)
    own = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(w)) for w in split if w), np.uint64, len(full))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(own) * _powers(_STEP, len(full))[:-1], dtype=np.uint64)])
    value = _mix((total[end] - total[first]) * _powers(_INVERSE, len(full))[first])
    return value, full[first], full[end - 1] + 1


def corpus_spans(documents: DataFrame, min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """(span, doc, text_hash, at, size, again): hash, first sentence and number of sentences of every span of every text.

    doc: the id; again: the span occurred before in the same text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, size=SLICE):
                found = [span_hashes(sentences(t), min_words, min_sentences) for t in cut.column("text").to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(h) for h, _, _ in found])
                if len(rows):
                    value, first, end = (np.concatenate([f[k] for f in found]) for k in range(3))
                    again = np.ones(len(rows), bool)
                    order = np.lexsort((first, value, rows))
                    same = (rows[order][1:] == rows[order][:-1]) & (value[order][1:] == value[order][:-1])
                    again[order] = np.r_[False, same]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value.view(np.int64)), cut.column("doc").take(pa.array(rows)), cut.column("text_hash").take(pa.array(rows)), pa.array(first.astype(np.int32)), pa.array((end - first).astype(np.int32)), pa.array(again)],
                        ["span", "doc", "text_hash", "at", "size", "again"],
                    )

    docs = documents.where("text is not null").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(docs, run, f"span long, doc {docs.schema['doc'].dataType.simpleString()}, text_hash long, at int, size int, again boolean")


def repeated(documents: DataFrame, min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """(doc, text_hash, at, size): the runs of sentences of each document that are a span's later occurrences.

    First occurrences are found by sums that start before the shuffle, so a span in a third of all documents is no
    burden there. Spans that occur in several documents are then joined back to their places by a shuffle, in which
    Spark splits what is skewed: the same way at every size.
    """
    found = corpus_spans(documents, min_words, min_sentences)
    key = F.struct("doc", "text_hash")
    first = found.groupBy("span").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first < last")
    first = materialize(first.select("span", "first"), "repeated-spans")
    later = found.join(first, "span", "left").where(F.col("again") | (key > F.col("first")))
    runs = later.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("at", "size")).alias("runs"))
    return runs.select("doc", "text_hash", F.transform("runs", lambda r: r["at"]).alias("at"), F.transform("runs", lambda r: r["size"]).alias("size"))


def _first_of_each_text(unnamed: DataFrame, copy: str) -> DataFrame:
    """Rows without an id, marked with the column copy: whether another of them has the same text.

    First the copies of each task are counted, then one row of each text and task: no task gets all copies of a text.
    """
    part, place = apart(unnamed, "_part", "_place")
    text = F.xxhash64("text")
    told = unnamed.withColumn(part, F.spark_partition_id())
    told = materialize(told.withColumn(place, F.row_number().over(Window.partitionBy(text, part).orderBy(part))), "unnamed")
    again = F.row_number().over(Window.partitionBy(text).orderBy(part)) > 1
    marked = told.where(F.col(place) == 1).withColumn(copy, F.col("text").isNotNull() & again).unionByName(told.where(F.col(place) > 1).withColumn(copy, F.col("text").isNotNull()))
    return marked.drop(part, place)


def deduplicate(documents: DataFrame, min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES, told: str = "repeats") -> DataFrame:
    """All rows and columns, the text without repeated sentences, and a struct of n_sentences and n_removed.

    told names the struct; a column of that name is replaced.
    """
    names = doc, hash_, at, size, copy, done_ = apart(documents, "_cut_doc", "_cut_hash", "_cut_at", "_cut_size", "_copy", "_cut")
    cuts = repeated(documents, min_words, min_sentences).toDF(*names[:4])
    unnamed = documents.where("doc_id is null")
    marked = documents.withColumn(copy, F.lit(False))
    if not unnamed.isEmpty():
        marked = marked.where("doc_id is not null").unionByName(_first_of_each_text(unnamed, copy))
    both = marked.join(cuts, marked["doc_id"].eqNullSafe(cuts[doc]) & (F.xxhash64(marked["text"]) == cuts[hash_]), "left")

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def cut(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, sizes, copies in columns:
            rows = []
            for text, at, size, copy in zip(texts, starts, sizes, copies, strict=True):
                parts = sentences(text or "")
                if copy:  # all its spans occurred before
                    _, first, end = span_hashes(parts, min_words, min_sentences)
                    at, size = first, end - first
                gone = np.zeros(len(parts), bool)
                for a, n in zip(at, size, strict=True) if at is not None else ():
                    gone[a : a + n] = True
                rows.append(("".join(p for p, g in zip(parts, gone, strict=True) if not g) if gone.any() else text, len(parts), int(gone.sum())))
            yield pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed"])
        give_back()

    done = in_batches(both).withColumn(done_, cut("text", at, size, copy))
    kept = [F.col(f"{done_}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns if c.lower() != told.lower()]
    return done.select(*kept, F.struct(f"{done_}.n_sentences", f"{done_}.n_removed").alias(told))
