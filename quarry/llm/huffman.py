"""Canonical length-limited Huffman codes of 16-bit ids, in blocks with bit-offset checkpoints (NumPy only)."""

from __future__ import annotations

import numpy as np

#: Longest code in bits: the decoding table has two to this power entries, 3 MB in all.
LIMIT = 20
#: Ids between two checkpoints; each checkpoint starts a lane that is decoded beside the others.
STRIDE = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Best code length of each symbol under the limit, by package-merge; 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    n = len(order)
    if n < 2:
        lengths[order] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError("more symbols than codes")
    leaves = counts[order].astype(np.int64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = len(level) // 2
        both = np.concatenate([leaves, level[0 : 2 * pairs : 2] + level[1 : 2 * pairs : 2]])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        is_leaf.append(rank < n)
    own = np.zeros(n, np.uint8)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        held = int(flags[:take].sum())
        own[:held] += 1
        take = 2 * (take - held)
    lengths[order] = own
    return lengths


def canonical(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each symbol, symbol and length by the next `limit` bits): codes ascend by length, then symbol."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    width = np.int64(1) << (limit - lengths[used].astype(np.int64))
    start = np.cumsum(width) - width
    codes = np.zeros(len(lengths), np.uint64)
    codes[used] = (start >> (limit - lengths[used].astype(np.int64))).astype(np.uint64)
    symbols, steps = np.zeros(1 << limit, np.uint16), np.ones(1 << limit, np.uint8)
    end = int(width.sum())
    symbols[:end] = np.repeat(used.astype(np.uint16), width)
    steps[:end] = np.repeat(lengths[used], width)
    return codes, symbols, steps


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, first bit first in each byte; bit offset of every STRIDE-th id)."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    if not size.all():
        raise ValueError("an id has no code")
    end = np.cumsum(size)
    at = end - size
    word, shift = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    over = shift < 0
    high = np.where(over, code >> np.where(over, -shift, 0).astype(np.uint64), code << np.where(over, 0, shift).astype(np.uint64))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[first]] = np.bitwise_or.reduceat(high, first)
    spilt = np.flatnonzero(over)
    words[word[spilt] + 1] |= code[spilt] << (64 + shift[spilt]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (int(end[-1]) + 7) >> 3], at[::STRIDE]


def decode(payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int], symbols: np.ndarray, steps: np.ndarray, limit: int = LIMIT) -> list[np.ndarray]:
    """The ids of several blocks; all lanes of all blocks take each step together."""
    base = np.cumsum([0, *(len(p) + 8 for p in payloads)])
    data = np.frombuffer(b"".join(p + bytes(8) for p in payloads) + bytes(8), np.uint8).astype(np.uint32)
    window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
    last = np.int64(len(window) - 1)
    at = np.concatenate([np.zeros(0, np.int64), *(c + 8 * b for c, b in zip(checkpoints, base[:-1], strict=True))])
    out = np.empty((STRIDE, len(at)), np.uint16)
    for k in range(STRIDE):
        peek = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[k] = symbols[peek]
        at = at + steps[peek]
    lanes = np.cumsum([0, *(len(c) for c in checkpoints)])
    flat = out.T
    return [flat[a:b].ravel()[:n] for a, b, n in zip(lanes[:-1], lanes[1:], sizes, strict=True)]
