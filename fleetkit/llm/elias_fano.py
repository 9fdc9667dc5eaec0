"""Elias-Fano sequences and a two-level n-gram trie in memory-mapped files."""

from __future__ import annotations

import os

import numpy as np

#: Step of the quantised natural logarithms; code 0 is "not in the trie".
LOG_STEP = 1 / 1024


def quantise(log_p: np.ndarray) -> np.ndarray:
    return (1 + np.clip(np.rint(-log_p / LOG_STEP), 0, 65_534)).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, (1 - code.astype(np.float64)) * LOG_STEP, -np.inf)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary.

    ``encode`` gives arrays that can be written and memory-mapped; a reader
    over them gives single elements (``at``) and finds keys inside a range
    (``find``) from the bits, through a directory of the ones before every
    64-bit word; nothing is decoded as a whole."""

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
        bits = np.zeros((n, low), np.uint8)
        for k in range(low):
            bits[:, k] = (v >> np.uint64(k)) & np.uint64(1)
        high = np.zeros((top >> low) + n + 1, np.uint8)
        high[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
        words = _words(high)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return {"low": np.append(_words(bits.ravel()), np.zeros(2, np.uint64)), "high": words, "before": before,
                "shape": np.array([n, low, top >> low], np.int64)}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low, self.last = map(int, arrays["shape"])
        self.low_bits, self.high, self.before = arrays["low"], arrays["high"], arrays["before"]

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th (from 0) one or zero of the high bits."""
        before = self.before if bit else 64 * np.arange(len(self.before)) - self.before
        word = np.searchsorted(before, k, "right") - 1
        left, x = (k - before[word]).astype(np.uint64), self.high[word]
        x = x if bit else ~x
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.uint64)
            up = left >= count
            left -= np.where(up, count, np.uint64(0))
            x = np.where(up, x >> np.uint64(width), x)
            at += width * up
        return 64 * word + at

    def _low(self, i: np.ndarray) -> np.ndarray:
        """Low bits of the elements at ``i``."""
        if not self.low:
            return np.zeros(len(i), np.uint64)
        word, off = np.divmod(i * self.low, 64)
        off = off.astype(np.uint64)
        x = self.low_bits[word] >> off
        x |= np.where(off > 0, self.low_bits[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return x & np.uint64((1 << self.low) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The elements at ``i``."""
        i = np.asarray(i, np.int64)
        return (self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.low) | self._low(i)

    def find(self, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per key the place in [lo, hi) of its successor (the first element
        that is not smaller; hi if none), and whether it is the key itself.

        The zeros of the high bits bound the elements that share the key's
        high bits; between these bounds and the given ones the low bits are
        searched by halving."""
        key = np.asarray(key, np.uint64)
        high = key >> np.uint64(self.low)
        inside = high <= self.last
        high = np.where(inside, high, 0).astype(np.int64)
        first = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) - high + 1, 0)
        last = self._select(high, 0) - high
        a = np.clip(np.where(inside, first, self.n), lo, hi)
        end = np.clip(np.where(inside, last, self.n), a, hi)
        want = key & np.uint64((1 << self.low) - 1)
        z = end.copy()
        open_ = np.flatnonzero(a < z)
        while len(open_):
            mid = (a[open_] + z[open_]) // 2
            less = self._low(mid) < want[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            z[open_] = np.where(less, z[open_], mid)
            open_ = open_[a[open_] < z[open_]]
        hit = a < end
        hit[hit] = self._low(a[hit]) == want[hit]
        return a, hit


def _words(bits: np.ndarray) -> np.ndarray:
    """Zeros and ones as little-endian 64-bit words, padded with zeros."""
    packed = np.packbits(bits, bitorder="little")
    return np.append(packed, np.zeros(-len(packed) % 8, np.uint8)).view("<u8").astype(np.uint64)


class Trie:
    """Contexts, their pointers and successors, each an Elias-Fano level, with
    one quantised log-probability per successor.

    Successors are stored relative to their context: the words of context rank
    r lie in [r * words, (r + 1) * words), which makes the whole level
    monotone.  A look-up finds the context's rank, reads its two pointers and
    searches the successor between them, all on the mapped bits."""

    #: Look-ups answered at once, which bounds their working memory.
    BATCH = 1 << 18

    @staticmethod
    def write(folder: str, context: np.ndarray, word: np.ndarray, log_p: np.ndarray) -> Trie:
        """From pairs sorted by (context, word), without repeats."""
        ranked, first = np.unique(context, return_index=True)
        words = int(word.max(initial=0)) + 1
        rank = np.repeat(np.arange(len(ranked)), np.diff(np.append(first, len(context))))
        levels = {"contexts": EliasFano.encode(ranked), "pointers": EliasFano.encode(np.append(first, len(context))),
                  "successors": EliasFano.encode(rank.astype(np.uint64) * np.uint64(words) + word.astype(np.uint64))}
        for name, arrays in levels.items():
            for part, array in arrays.items():
                np.save(os.path.join(folder, f"{name}.{part}.npy"), array)
        np.save(os.path.join(folder, "words.npy"), np.array([words], np.int64))
        np.save(os.path.join(folder, "codes.npy"), quantise(log_p))
        return Trie(folder)

    def __init__(self, folder: str):
        level = lambda name: EliasFano({p: np.load(os.path.join(folder, f"{name}.{p}.npy"), mmap_mode="r")
                                        for p in ("low", "high", "before", "shape")})
        self.contexts, self.pointers, self.successors = level("contexts"), level("pointers"), level("successors")
        self.words = int(np.load(os.path.join(folder, "words.npy"))[0])
        self.codes = np.load(os.path.join(folder, "codes.npy"), mmap_mode="r")

    def codes_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of each pair, 0 where the trie has it not."""
        out = np.zeros(len(context), np.uint16)
        if self.contexts.n:
            for a in range(0, len(context), self.BATCH):
                part = slice(a, a + self.BATCH)
                out[part] = self._codes(context[part], word[part])
        return out

    def _codes(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        # neighbours with one context share its rank and pointers
        new = np.concatenate([[True], context[1:] != context[:-1]])
        asked = context[new]
        rank, known = self.contexts.find(asked, np.zeros(len(asked), np.int64), np.full(len(asked), self.contexts.n))
        rank[~known] = 0
        lo, hi = (self.pointers.at(rank + k).astype(np.int64) for k in (0, 1))
        of = np.cumsum(new) - 1
        here = np.flatnonzero(known[of] & (word < self.words))
        of = of[here]
        at, hit = self.successors.find(rank[of].astype(np.uint64) * np.uint64(self.words)
                                       + word[here].astype(np.uint64), lo[of], hi[of])
        out = np.zeros(len(context), np.uint16)
        out[here[hit]] = self.codes[at[hit]]
        return out
