"""Language identification by rank-order profiles of letter n-grams.

A language's profile is the order of its most frequent n-grams over all training documents: one to three characters of
the text in lower case, in which each run of anything but letters is one space, as are both ends. A document's own most frequent n-grams are compared by out-of-place distance: how far each
stands from its place in the profile, the largest distance where the profile lacks it. The nearest profile wins.

Nulls and ties: texts that are null or without letters get `und` and score 0; without any training document all do.
A text none of whose n-grams is in a profile is as far from all languages; n_known, how many of the n_grams compared
are in one, tells such texts (n_known 0) from those without letters (n_grams 0).
Rows with a null language train nothing. N-grams of equal count rank by code, languages of equal distance by name.
Texts are used whole. Repeated rows are predicted, and counted in training, once each. Columns other than doc_id,
text and, for training, lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import give_back, in_batches, map_arrow, slices

UNDETERMINED = "und"
#: N-grams in a language's profile and in a document's.
PROFILE, DOCUMENT = 400, 300
#: Distinct n-grams that a task counts before it hands its counts on.
HELD = 200_000
#: Bytes of text whose n-grams are counted at a time: some 25 MB of codes and copies.
SLICE = 1 << 18

_letters: list[np.ndarray] = []
_SPACE = ord(" ")


def _symbols(text: str) -> np.ndarray:
    """Code points of the letters, lower-cased; one space for each run of anything else, one at each end; empty without letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    kept = np.zeros(len(points) + 2, np.uint64)
    np.multiply(points, _letters[0][points], out=kept[1:-1], casting="unsafe")
    kept = kept[np.r_[True, (kept[1:] != 0) | (kept[:-1] != 0)]]
    kept[kept == 0] = _SPACE  # a 0 at the end of an n-gram would make it the same as a shorter one
    return kept if len(kept) > 2 else kept[:0]


def ngrams(text: str) -> np.ndarray:
    """Codes of all one- to three-letter n-grams, 21 bits a letter."""
    s = _symbols(text)
    two = s[:-1] | s[1:] << np.uint64(21)
    return np.concatenate([s[s != _SPACE], two, two[:-1] | s[2:] << np.uint64(42)])


def _counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        return codes[first], np.diff(np.r_[first, len(codes)])
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(weights, first)


def learn_profiles(labelled: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language -> codes of its most frequent n-grams, by rank. The driver gets `size` rows for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for cut in slices(batch, size=SLICE):
                by: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(cut.column("text").to_pylist(), cut.column("lang").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(ngrams(text))
                for lang, parts in by.items():
                    codes, n = _counted(np.concatenate(parts))
                    if lang in held and len(codes):
                        codes, n = _counted(np.concatenate([held[lang][0], codes]), np.concatenate([held[lang][1], n]))
                    if len(codes):
                        held[lang] = codes, n
                if sum(len(c) for c, _ in held.values()) > HELD:
                    yield from rows()
        yield from rows()

    counts = map_arrow(labelled.where("text is not null and lang is not null").select("text", "lang"), run, "lang string, code long, n long")
    ranked = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")))
    found: dict[str, list] = {}
    for row in ranked.where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        found.setdefault(row["lang"], []).append(row["code"])
    return {lang: np.array(codes, np.uint64) for lang, codes in found.items()}


class Model:
    """predict(text) -> (language, score, n_grams, n_known): score is the runner-up's share of both distances, 0.5 to 1."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE, document: int = DOCUMENT):
        self._langs = sorted(profiles)
        self._size, self._document = size, document
        self._codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self._ranks = np.full((len(self._codes) + 1, len(self._langs)), -1, np.int64)
        for k, lang in enumerate(self._langs):
            self._ranks[np.searchsorted(self._codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float, int, int]:
        codes, n = _counted(ngrams(text or ""))
        if not len(codes) or not self._langs:
            return UNDETERMINED, 0.0, min(len(codes), self._document), 0
        if len(codes) > self._document:  # those that can be among the first, by count alone
            least = np.partition(n, len(n) - self._document)[len(n) - self._document]
            codes, n = codes[n >= least], n[n >= least]
        order = np.argsort(-n, kind="stable")[: self._document]
        at = np.searchsorted(self._codes, codes[order])
        at[at == len(self._codes)] = 0
        ranks = self._ranks[np.where(self._codes[at] == codes[order], at, len(self._codes))]
        place = np.arange(len(order))[:, None]
        known = int((ranks >= 0).any(axis=1).sum())
        distance = np.where(ranks < 0, self._size, np.abs(ranks - place)).sum(axis=0)
        best = int(np.argmin(distance))
        if len(distance) == 1:
            return self._langs[0], 1.0, len(order), known
        first, second = np.partition(distance, 1)[:2].tolist()
        return self._langs[best], second / (first + second) if second else 0.5, len(order), known


def predict(documents: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, told: str = "lang_id") -> DataFrame:
    """All columns of documents and a struct of lang_pred, score, n_grams and n_known, named by told; a column of that name is replaced."""
    sent = documents.sparkSession.sparkContext.broadcast(profiles)  # size numbers for each language

    @F.pandas_udf("lang_pred string, score double, n_grams long, n_known long")
    def tell(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(sent.value, size)
        for part in texts:
            yield pd.DataFrame([model.predict(t) for t in part], columns=["lang_pred", "score", "n_grams", "n_known"])
        give_back()

    return in_batches(documents).withColumn(told, tell("text"))


def identify(documents: DataFrame, training: Column) -> DataFrame:
    """predict() with profiles learnt from the rows for which training holds."""
    return predict(documents, learn_profiles(documents.where(training)))
