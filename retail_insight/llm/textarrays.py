"""Words and shingles of many texts as flat numpy arrays (used inside tasks).

A word is a maximal run of bytes other than space and \\x09-\\x0D, with A-Z
lower-cased. Every word and shingle becomes a 64-bit hash that depends on its
content alone, so tasks, runs and machines agree on it.
"""

from __future__ import annotations

import numpy as np

CHUNK_BYTES = 1 << 21
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """Hashes the words of byte strings with one running polynomial sum."""

    def __init__(self) -> None:
        self.byte_value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        self.is_space = np.zeros(256, dtype=bool)
        self.is_space[[32, 9, 10, 11, 12, 13]] = True
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(_ODD, n + 1), powers(_ODD_INVERSE, n + 1)

    def _spans(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, dtype=np.uint8)
        edge = np.ones(len(raw) + 2, dtype=bool)
        edge[1:-1] = self.is_space[raw]
        turns = np.flatnonzero(edge[1:] != edge[:-1])
        return raw, turns[::2], turns[1::2]

    def _piece(self, data: bytes, codes: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        raw, start, end = self._spans(data)
        if codes is not None:
            codes.append(self._codes(raw, start, end))
        self._grow(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.byte_value[raw] * self.up[: len(raw)], dtype=np.uint64, out=total[1:])
        return mix64((total[end] - total[start]) * self.down[start]), start

    @staticmethod
    def _codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        last = end - 1
        a, z = raw[start].astype(np.int64), raw[last].astype(np.int64)
        b, y = raw[np.minimum(start + 1, last)].astype(np.int64), raw[np.maximum(last - 1, start)].astype(np.int64)
        return ((8191 * a + 131 * b + 31 * y + 2053 * z) & 0xFFFF) * 3 + (z == 46) + 2 * (z == 44)

    def one(self, data: bytes, codes: list | None = None) -> np.ndarray:
        """Word hashes of one text, however long, in pieces cut at spaces."""
        if len(data) <= CHUNK_BYTES:
            return self._piece(data, codes)[0]
        found, at = [], 0
        while at < len(data):
            stop = at + CHUNK_BYTES
            if stop < len(data):
                cut = max(data.rfind(c, at, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut <= at:  # a single word fills the piece: go on to its end
                    ends = [p for p in (data.find(c, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
                    cut = min(ends, default=len(data))
                stop = cut
            found.append(self._piece(data[at:stop], codes)[0])
            at = stop + (stop < len(data))
        return np.concatenate(found)

    def many(self, texts, codes: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, text after text, and the offsets at which
        each text's words begin (one more than texts). A null is empty."""
        hashes, counts, group, room = [], [], [], 0

        def flush() -> None:
            if group:
                h, start = self._piece(b"\n".join(group), codes)
                stop = np.cumsum([len(g) + 1 for g in group])
                upto = np.searchsorted(start, stop, side="left")
                hashes.append(h)
                counts.extend(np.diff(upto, prepend=0).tolist())
                group.clear()

        for t in texts:
            data = t.encode("utf-8").lower() if t else b""
            if len(data) > CHUNK_BYTES:
                flush()
                room = 0
                hashes.append(self.one(data, codes))
                counts.append(len(hashes[-1]))
                continue
            if room + len(data) > CHUNK_BYTES:
                flush()
                room = 0
            group.append(data)
            room += len(data) + 1
        flush()
        flat = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        return flat, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)

    def many_with_codes(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """many(), and a code of each word's looks: a 16-bit mix of its first
        and last two bytes, times 3, plus whether it ends in a stop (1) or a
        comma (2)."""
        codes: list[np.ndarray] = []
        flat, cut = self.many(texts, codes)
        return flat, cut, np.concatenate([*codes, np.empty(0, dtype=np.int64)])


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in text order; a text of fewer
    words (at least one) has one shingle of all its words, an empty one none."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : n - size + 1 + j]
    return mix64(out)


def shingle_sets(texts, size: int, hasher: WordHasher | None = None):
    """Yield each text's sorted distinct shingle hashes."""
    flat, offsets = (hasher or WordHasher()).many(texts)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield np.unique(shingles(flat[a:b], size))
