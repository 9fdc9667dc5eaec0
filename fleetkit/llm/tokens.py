"""Token ids of a public word-end BPE vocabulary, with a bounded piece cache."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# Fixed value: how the vocabulary file splits a lower-cased text before merging
# ({L} and {N} stand for the letters and numbers of Unicode).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"
#: Characters other than those whose normal form and classes are beyond doubt:
#: printable Latin and plain white space.
LAST = 0x24F
ODD = re.compile(rf"[^\t-\r\x20-\x7e\xa1-{chr(LAST)}]")


def _of_category(first: str) -> str:
    """The plain characters of a Unicode category, for a regular expression's class."""
    return "".join(chr(c) for c in range(LAST + 1) if unicodedata.category(chr(c))[0] == first)


class WordBpe:
    """Encodes texts with a ``tokenizers`` file whose merges never cross words.

    A word's ids do not depend on its neighbours, so each distinct piece is
    encoded once and looked up afterwards; the cache is emptied when it holds
    ``cache`` pieces.  Texts with other characters than plain Latin ones, or
    with a special token's bracket, go through the library whole."""

    def __init__(self, path: str | None = None, cache: int = 300_000):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("word_bpe_49k.json")
        self.lib, self.cache = Tokenizer.from_file(path), cache
        classes = {"L": _of_category("L"), "N": _of_category("N")}
        self.pieces = re.compile(PIECES.format(**classes)).findall
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        new: list[str] = []

        class Index(dict):
            def __missing__(self, piece):
                self[piece] = at = len(self)
                new.append(piece)
                return at

        self.index, self.new = Index(), new
        self.flat, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        if not self.new:
            return
        ids = np.array(self.lib.encode(" ".join(self.new), add_special_tokens=False).ids, np.uint32)
        size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(size) != len(self.new):                        # a piece that splits again by itself
            each = [self.lib.encode(p, add_special_tokens=False).ids for p in self.new]
            ids, size = np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each])
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, ids])
        self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, size])
        self.new.clear()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none), special tokens' strings as ordinary text."""
        if len(self.index) > self.cache:
            self._reset()
        codes: list[int] = []
        ends, whole = [], {}
        for k, text in enumerate(texts):
            if text and (ODD.search(text) or "<|" in text):
                whole[k] = np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)
            elif text:
                codes.extend(map(self.index.__getitem__, self.pieces(text.lower())))
            ends.append(len(codes))
        self._learn()
        code = np.array(codes, np.int64)
        size = self.size[code] if len(code) else np.zeros(0, np.int64)
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.flat[np.repeat(self.at[code] - (stop - size), size) + np.arange(total)] if total else self.flat[:0]
        cuts = np.concatenate([[0], stop])[ends].tolist()
        return [whole.get(k, ids[a:b]) for k, (a, b) in enumerate(zip([0, *cuts], cuts))]


_LOADED: dict[tuple, WordBpe] = {}


def loaded(path: str | None = None) -> WordBpe:
    """One encoder per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
