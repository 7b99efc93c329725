"""64-bit hashes of word n-grams, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

from .common import SPACES

_SEED = 0x9E3779B97F4A7C15
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP_BYTES = 1 << 20


def _fmix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a public 64-bit hash: every bit of the input changes about half of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _tables():
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    space = np.zeros(256, bool)
    space[list(SPACES.encode())] = True
    value = np.random.default_rng(_SEED).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return space, value[fold]


_SPACE, _VALUE = _tables()
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash (A-Z as a-z): sums of byte values times powers of a base,
    taken from prefix sums and moved to power 0."""
    a = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[a], [True])).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(len(a) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[a] * up[: len(a)], dtype=np.uint64)))
    return begin, _fmix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _gram_hashes(words: np.ndarray, owner: np.ndarray, docs: int, size: int) -> list[np.ndarray]:
    """For each document its distinct n-gram hashes in rising order; fewer words make one n-gram."""
    odd = np.uint64(2654435769)
    out = []
    bounds = np.searchsorted(owner, np.arange(docs + 1))
    n = len(words) - size + 1
    grams = np.zeros(max(0, n), np.uint64)
    for i in range(size if n > 0 else 0):
        grams = grams * odd + words[i : i + n]
    grams = _fmix(grams)
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - b >= size:
            out.append(np.unique(grams[b : e - size + 1]))
        elif e > b:
            whole = np.uint64(e - b)
            for w in words[b:e]:
                whole = whole * odd + w
            out.append(_fmix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], size: int = 4) -> list[np.ndarray]:
    """Distinct hashes of `size`-word shingles of each text. Texts are taken about a megabyte at a time."""
    with np.errstate(over="ignore"):
        out, held, room = [], [], 0
        for text in texts:
            raw = (text or "").encode()
            held.append(raw)
            room += len(raw)
            if room >= _STEP_BYTES:
                out += _sets(held, size)
                held, room = [], 0
        return out + _sets(held, size)


def _sets(raws: list[bytes], size: int) -> list[np.ndarray]:
    if not raws:
        return []
    begin, words = _hash_words(b" ".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    return _gram_hashes(words, np.searchsorted(ends, begin, side="right"), len(raws), size)
