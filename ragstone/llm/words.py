"""Hashes of words and of runs of words, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash
from numpy.lib.stride_tricks import sliding_window_view

U = np.uint64


#: White space of the word rule, by byte.
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte.
_BYTE = np.array([xxhash.xxh64_intdigest(f"byte:{i}".encode()) for i in range(256)], U)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of a text that are hashed at once.
_SLICE = 1 << 20
_powers = (np.ones(1, U), np.ones(1, U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 16), base, U)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = tuple(made)
    return _powers


def runs_of(raw: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that the table `kind` marks."""
    edges = np.flatnonzero(np.diff(kind[raw].view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def hash_sums(raw: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any piece follows, see piece_hashes()."""
    powers, _ = _power_tables(len(raw) + 1)
    return np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[raw] * powers[: len(raw)])])


def piece_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each piece [start, end), the same wherever the piece stands."""
    _, inverses = _power_tables(len(sums))
    return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F))


def _hash_bytes(raw: np.ndarray) -> np.ndarray:
    starts, ends = runs_of(raw, ~_GAP)
    return piece_hashes(hash_sums(raw), starts, ends)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, computed for all words of a text at once."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if len(data) <= _SLICE:
        return _hash_bytes(np.frombuffer(data, np.uint8))
    out, start = [], 0
    while start < len(data):
        end = min(len(data), start + _SLICE)
        while end < len(data) and not _GAP[data[end]]:
            end += 1
        out.append(_hash_bytes(np.frombuffer(data, np.uint8, end - start, start)))
        start = end
    return np.concatenate(out)


def split_words(text: str | None) -> list[bytes]:
    """The words of a text; bytes.split() takes the same six characters for white space as the word rule."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of x spread over all 64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd numbers that depend on the seed alone."""
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{i}".encode()) | 1 for i in range(n)], U)


def run_hashes(hashes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of each run of `length` consecutive words; empty if there are fewer."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, U)
    total = np.zeros(n, U)
    for i, m in enumerate(multipliers(length, seed)):
        total += hashes[i : n + i] * m
    return mixed(total)


def anchors(seeds: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` consecutive seeds, the position of its smallest (the leftmost of equal ones)."""
    if len(seeds) < span:
        return np.empty(0, np.int64)
    return sliding_window_view(seeds, span).argmin(1) + np.arange(len(seeds) - span + 1)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values are in the ascending array; it isn't sorted again, as np.isin would."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values
