"""Hashes of words and of word windows, for whole lots of texts at once (used inside tasks)."""

from __future__ import annotations

import numpy as np

from auditloom.llm.common import SPACE_CHARS

_BLOCK = 1 << 20
_M = (1 << 64) - 1
#: For each of two independent hashes the base for bytes and that for words; odd, so that they have inverses modulo 2^64.
_BASES = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0x2545F4914F6CDD1D))

_space = np.zeros(256, bool)
_space[[ord(c) for c in SPACE_CHARS]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits; different numbers stay different."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_bytes = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)) for base, _ in _BASES]


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of base and of its inverse modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, _BLOCK + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(b)
            both.append(np.cumprod(p))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def _stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each pair, by differences of one running sum."""
    up, down = _power(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts, one after the other: starts, ends (in raw), hashes, and counts for each text."""

    def __init__(self, texts: list[str]):
        encoded = [t.encode("utf-8", "replace") for t in texts]
        self.raw = b"\n".join(encoded) + b"\n"
        b = np.frombuffer(self.raw, np.uint8)
        inside = ~_space[b]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        self.starts, self.ends = edge[::2], edge[1::2]
        limits = np.cumsum([0] + [len(x) + 1 for x in encoded])
        self.offsets = np.searchsorted(self.starts, limits)
        self.counts = np.diff(self.offsets)
        self.hashes = self._hashed(0)

    def _hashed(self, family: int) -> np.ndarray:
        """A 64-bit hash of each word, by one of two independent ways."""
        b, base_of = np.frombuffer(self.raw, np.uint8), _BASES[family][0]
        out = np.zeros(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + _BLOCK)))
            values = _bytes[family][b[base : self.ends[j - 1]]]
            out[i:j] = _stretches(values, self.starts[i:j] - base, self.ends[i:j] - base, base_of)
            i = j
        return out

    def windows(self, length: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the window of so many words that begins at each word, and whether it stays in its text.

        The hashes of both families together are 128 independent bits.
        """
        n = len(self.starts)
        hashes = self.hashes if family == 0 else self._hashed(family)
        out, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n < length:
            return out, ok
        step = _BLOCK
        for i in range(0, n - length + 1, step):
            part = hashes[i : i + step + length - 1]
            at = np.arange(len(part) - length + 1)
            out[i : i + len(at)] = _stretches(part, at, at + length, _BASES[family][1])
        left = np.repeat(self.offsets[1:], self.counts) - np.arange(n)
        ok = left >= length
        return out, ok

    def text(self, i: int, gone: np.ndarray | None = None) -> bytes:
        """The words of the i-th text joined by one space, without those gone."""
        a, z = self.offsets[i], self.offsets[i + 1]
        keep = range(a, z) if gone is None else (a + np.flatnonzero(~gone)).tolist()
        s, e, raw = self.starts, self.ends, self.raw
        return b" ".join([raw[s[k] : e[k]] for k in keep])


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or largest) of values[i : i + width] for each i; beyond the end nothing is added."""
    f = np.minimum if least else np.maximum
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            out[:-step] = f(out[:-step], out[step:])
        have += step
    return out
