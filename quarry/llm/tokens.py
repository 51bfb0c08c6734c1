"""Token ids of whole texts by a public byte-level BPE vocabulary, with a bounded cache of encoded pieces.

The vocabulary's pre-tokenizer never joins characters across certain places (before a space or line feed, after a
letter that a full stop or comma follows), so pieces between such places can be encoded on their own, once, by the
tokenizers library; texts in which those places are not certain are encoded whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Encoded pieces that one Python worker remembers, in Arrow and NumPy arrays: some 5 MB. Others are encoded again in
#: each slice they come in.
CACHE_PIECES = 200_000
_LINE_FEED = 198
#: With any of this in a text it is encoded whole: runs of white space or of punctuation, other white space, specials.
_UNSURE = r"[^\p{L}\p{N}][.,]|[ \n][ \n]|[ \n]$|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class PieceEncoder:
    """encode(texts) -> one array of 16-bit ids for each text, without the end id."""

    def __init__(self, path: str | None = None, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self._whole = Tokenizer.from_file(path)
        if self._whole.get_vocab_size() > 65536:
            raise ValueError("ids must fit 16 bits")
        self._model = self._whole.model
        self._letters = _byte_letters()
        self._words = pa.array(["", "\n"], pa.string())  # the pieces known, their ids in one array, and where each one's begin
        self._flat = np.array([_LINE_FEED], "<u2")
        self._starts = np.array([0, 0, 1], np.int64)
        self._most = cache_pieces

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u2")

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; all pieces are spelt in the vocabulary's letters at once, where 0 parts them."""
        spelt = "\0".join(pieces).encode().decode("latin-1").translate(self._letters).split(self._letters[0])
        tokenize, out = self._model.tokenize, []
        for piece, letters in zip(pieces, spelt, strict=True):
            if piece.lstrip(" ").isalpha():  # one pre-token
                ids = [t.id for t in tokenize(letters)]
            else:
                ids = self._whole.encode(piece, add_special_tokens=False).ids
            out.append(array("H", ids).tobytes())
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.fill_null("")
        unsure = pc.match_substring_regex(texts, _UNSURE)
        sure = pc.if_else(unsure, "", texts)
        for mark, cut in ((" ", "\0 "), ("\n", "\0\n\0"), (".", "\0."), (",", "\0,")):
            sure = pc.replace_substring(sure, mark, cut)
        split = pc.split_pattern(sure, "\0")
        pieces = split.flatten().dictionary_encode()
        known = pc.index_in(pieces.dictionary, value_set=self._words)
        place = known.fill_null(-1).to_numpy().astype(np.int64)
        flat, starts = self._flat, self._starts
        if known.null_count:
            missing = pieces.dictionary.filter(known.is_null())
            learnt = self._learn(missing.to_pylist())
            place[place < 0] = len(self._words) + np.arange(len(missing))
            flat = np.concatenate([flat, np.frombuffer(b"".join(learnt), "<u2")])
            starts = np.concatenate([starts, starts[-1] + np.cumsum(np.fromiter(map(len, learnt), np.int64, len(learnt)) >> 1)])
            if room := min(self._most - len(self._words), len(missing)):
                self._words = pa.concat_arrays([self._words, missing[:room]])
                self._starts = starts[: len(self._words) + 1]
                self._flat = flat[: self._starts[-1]]
        # the ids of all pieces, gathered from the distinct ones
        code = place[pieces.indices.to_numpy()]
        each = starts[code + 1] - starts[code]
        end = np.cumsum(each)
        total = int(end[-1]) if len(end) else 0
        flat = flat[np.arange(total) + np.repeat(starts[code] - (end - each), each)]
        bounds = np.concatenate([[0], end])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in np.flatnonzero(unsure.to_numpy(zero_copy_only=False)):
            out[k] = self._ids(texts[int(k)].as_py())
        return out


_ENCODERS: dict[str | None, PieceEncoder] = {}


def encoder(path: str | None = None) -> PieceEncoder:
    """This Python worker's encoder of that vocabulary: reused, with its cache, by all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
