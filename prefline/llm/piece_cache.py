"""Encoding with the tokenizers library, each distinct pre-token once per worker and cache.

A tokenizer's model sees one pre-token at a time, so a text's ids are its pre-tokens'
ids one after the other.  Text repeats its pre-tokens.  Here texts are split with array
operations, pre-tokens are looked up by a 64-bit hash, and those not met before go to
the library's model.  The cache is bounded and begins anew when it is full; no id depends on it.

The split covers ASCII, Latin-1, Latin Extended-A and general punctuation.  A text with
any other character goes through the library as a whole.
"""

from __future__ import annotations

import os

import numpy as np

from .common import KEPT, Rolling, mix, spans

CACHE_ENTRIES = 1 << 20
SLOTS = 1 << 22
SPACE, LETTER, NUMBER, OTHER = range(4)
USUAL = r"\t\n\r\x20-\x7e¡-įı-ſ‐-‧‰-›"
# How byte-level vocabularies write a byte that is no visible Latin-1 letter: the next free one.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LETTERS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_READY: dict[str, "CachedEncoder"] = {}
KEPT.append(_READY)
_HASH = Rolling(0xA0761D6478BD642F)


def _classes() -> np.ndarray:
    import regex

    out = np.full(0x2100, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        out[[c for c in range(len(out)) if regex.match(pattern, chr(c))]] = kind
    return out


class CachedEncoder:
    """Ids of texts by one vocabulary file; ``words`` (its files with a normaliser):
    lower case, digits single, white space dropped; else byte-level pieces with a space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.letters = np.arange(256, dtype=np.uint32)
        self.letters[list(LETTERS)] = list(LETTERS.values())
        self.letters[0] = 0  # stands between pieces; no piece holds it
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = self.tokenizer.normalizer is not None
        unusual = regex.compile(f"[^{USUAL}]").match
        self.unusual = np.array([bool(unusual(chr(c))) for c in range(0x2100)] + [True])
        self.kinds = _classes()
        self.code = mix(np.arange(1, 1 + len(self.kinds), dtype=np.uint64))
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)  # 0: free
        self.entry = np.zeros(SLOTS, np.int32)
        self.first, self.size = np.zeros(CACHE_ENTRIES, np.int64), np.zeros(CACHE_ENTRIES, np.int32)
        self.flat, self.used, self.count = np.zeros(1 << 20, np.uint32), 0, 0

    def starts(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Flags where pre-tokens start; ``rows``: where texts start."""
        kind = self.kinds[points]
        n = len(points)
        row = np.zeros(n, bool)
        row[rows[rows < n]] = True
        start = row.copy()
        start[1:] |= kind[1:] != kind[:-1]
        if self.words:
            start |= kind == NUMBER
        else:
            # the last white space before something else is a piece of its own or,
            # if it is a space, goes with what follows
            b = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~row[1:]) + 1
            start[b - 1] = True
            start[b[points[b - 1] == 0x20]] = False
        quote = np.flatnonzero(start & (points == 0x27))
        if len(quote):
            after = np.zeros((2, len(quote)), np.uint32)
            for k in (1, 2):
                at = np.minimum(quote + k, n - 1)
                inside = (quote + k < n) & ~row[at]
                after[k - 1] = np.where(inside & (after[0] > 0 if k == 2 else True), points[at], 0)
            one = np.isin(after[0], [ord(c) for c in "stmd"])
            two = np.zeros(len(quote), bool)
            for a, b in ("re", "ve", "ll"):
                two |= (after[0] == ord(a)) & (after[1] == ord(b))
            for which, length in ((one, 2), (two, 3)):
                at = quote[which]
                for k in range(1, length):
                    start[at + k] = False
                end = at + length
                start[end[end < n]] = True
        return start

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of the hashes, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int32)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            key = self.keys[slot]
            hit = key == hashes[left]
            out[left[hit]] = self.entry[slot[hit]]
            go = ~hit & (key != 0)
            left, slot = left[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        tokenize = self.tokenizer.model.tokenize
        for i in range(0, len(pieces), 4096):
            raw = np.frombuffer("\0".join(pieces[i:i + 4096]).encode(), np.uint8)
            spelt = self.letters[raw].tobytes().decode("utf-32-le").split("\0")
            lists = [[t.id for t in tokenize(p)] for p in spelt]
            sizes = np.fromiter(map(len, lists), np.int32, len(lists))
            ids = np.fromiter((x for y in lists for x in y), np.uint32, int(sizes.sum()))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            self.flat[self.used:self.used + len(ids)] = ids
            new = np.arange(self.count, self.count + len(lists), dtype=np.int32)
            self.size[new] = sizes
            self.first[new] = self.used + np.cumsum(sizes) - sizes
            self.used, self.count = self.used + len(ids), self.count + len(lists)
            left, slot = np.arange(len(lists)), (hashes[i:i + 4096] & np.uint64(SLOTS - 1)).astype(np.int64)
            while len(left):
                free = np.flatnonzero(self.keys[slot] == 0)
                _, pick = np.unique(slot[free], return_index=True)  # one of those that meet in a slot
                put = free[pick]
                self.keys[slot[put]], self.entry[slot[put]] = hashes[i + left[put]], new[left[put]]
                stay = np.ones(len(left), bool)
                stay[put] = False
                left, slot = left[stay], (slot[stay] + 1) & (SLOTS - 1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        joined, lengths = "".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        odd = np.flatnonzero(self.unusual[np.minimum(points, 0x2100)])
        whole = {}
        if len(odd):
            rows = np.unique(np.searchsorted(np.cumsum(lengths), odd, "right")).tolist()
            whole = {i: np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in rows}
            joined = "".join("" if i in whole else t for i, t in enumerate(texts))
            lengths[rows] = 0
        if self.words:
            joined = joined.lower()  # these characters keep their number, and stay as they are under NFC
        if self.words or whole:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ids, counts = self._usual(joined, points, lengths)
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in whole.items():
                parts[i] = x
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    def _usual(self, joined: str, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.cumsum(lengths) - lengths
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(lengths), np.int64)
        begin = np.flatnonzero(self.starts(points, rows))
        end = np.append(begin[1:], len(points))
        if self.words:
            kept = self.kinds[points[begin]] != SPACE
            begin, end = begin[kept], end[kept]
        hashes = _HASH.ranges(_HASH.prefix(self.code[points]), begin, end)
        hashes = mix(hashes + (end - begin).astype(np.uint64)) | np.uint64(1)
        # so many pre-tokens at a time as the cache has room for, were they all different
        parts = [self._known(joined, begin[i:i + CACHE_ENTRIES], end[i:i + CACHE_ENTRIES], hashes[i:i + CACHE_ENTRIES])
                 for i in range(0, len(begin), CACHE_ENTRIES)]
        ids = np.concatenate([np.zeros(0, np.uint32), *[x for x, _ in parts]])
        upto = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int32), *[x for _, x in parts]]))])
        bound = upto[np.searchsorted(begin, np.append(rows, len(points)))]
        return ids, np.diff(bound)

    def _known(self, joined: str, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per pre-token) of at most ``CACHE_ENTRIES`` pre-tokens."""
        entry = self._find(hashes)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            if self.count + len(new) > CACHE_ENTRIES:
                self._clear()
                new, at = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            at = missing[at]
            self._learn(new, [joined[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist())])
            entry[missing] = self._find(hashes[missing])
        size = self.size[entry]
        return self.flat[spans(self.first[entry], size)], size

    def arrays(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Each text's ids and the end id."""
        ids, counts = self.encode(texts)
        out = np.full(len(ids) + len(texts), end, np.uint32)
        bounds = np.cumsum(counts + 1)
        body = np.ones(len(out), bool)
        body[bounds - 1] = False
        out[body] = ids
        return np.split(out, bounds[:-1])


def encoder(path: str) -> CachedEncoder:
    """The worker's encoder of that vocabulary file."""
    if path not in _READY:
        _READY[path] = CachedEncoder(path)
    return _READY[path]


def in_pieces(texts: list[str], limit: int):
    """Index ranges of the texts with at most ``limit`` characters each, or one text."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)
