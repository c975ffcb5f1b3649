"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Powers for texts up to this length are kept by a worker.
KEPT = 1 << 19
#: Letters and digits of any script map to a value over 0, all else to 0.
_VALUE = np.array([c + 1 if chr(c).isalnum() else 0 for c in range(0x110000)], dtype=np.uint32)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if n <= len(_powers[0]):
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_BASE, _INVERSE):
        one = np.full(max(n, KEPT), base, dtype=np.uint64)
        one[0] = 1
        made.append(np.multiply.accumulate(one))
    if n <= KEPT:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (a run of letters and digits, lower-cased), and the number of words of each text."""
    low = [t.lower() for t in texts]
    data = np.frombuffer(" ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    value = _VALUE[data].astype(np.uint64)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = value > 0
    edge = np.diff(inside)
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(value * power[:-1], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    bounds = np.cumsum(np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1)
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return hashes, counts


#: Kinds of bytes: 0 white space, 1 letters (and all of other code points), 2 digits, 3 other marks.
_KIND = np.full(256, 3, dtype=np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[b for b in range(256) if chr(b).isalpha() and b < 128 or b >= 128]] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += 32


def run_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one kind of byte: the hash of each (A-Z as a-z), its shape (below 96), and each text's number of runs.

    A shape is the kind, whether all letters are capitals (two at least), whether the first is, and the length up to 7.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
    kind = _KIND[data]
    change = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    starts = change[:-1] if len(change) else change
    ends = change[1:] if len(change) else change
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[data] * power[:-1], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    capitals = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_UPPER[data], out=capitals[1:])
    size = ends - starts
    upper = capitals[ends] - capitals[starts]
    case = np.where((upper == size) & (size > 1), 2, (_UPPER[data[starts]] > 0).astype(np.int64))
    shape = ((kind[starts].astype(np.int64) * 3 + case) << 3) + np.minimum(size, 7)
    bounds = np.cumsum(np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) + 1)
    return hashes, shape, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_hashes(texts: list[str], length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of `length` words, and how many each text has.

    A text with fewer words (one at least) has one shingle of all of them.
    """
    words, counts = word_hashes(texts)
    texts_of = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(len(words)) - first
    keep = (place + length <= counts[texts_of]) | (place == 0)
    found = np.zeros(len(words), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(length, dtype=np.uint64)])
    padded_text = np.concatenate([texts_of, np.full(length, -1)])
    factor = np.uint64(1)
    for j in range(length):
        same = padded_text[j : j + len(words)] == texts_of
        found += np.where(same, padded[j : j + len(words)], np.uint64(0)) * factor
        factor = np.uint64(int(factor) * 0xD6E8FEB86659FD93 % (1 << 64))
    kept = mix(found[keep])
    return kept, np.bincount(texts_of[keep], minlength=len(texts))


def multisets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text number, hash and multiplicity of each distinct hash of each text, ordered by both."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(at, append=len(hashes))


def overlap(left: list[str], right: list[str]) -> np.ndarray:
    """The exact weighted Jaccard similarity of the shingle multisets of each pair of texts (0 without shingles)."""
    n = len(left)
    hashes, counts = shingle_hashes([*left, *right])
    owner, hashes, weight = multisets(hashes, counts)
    side = owner >= n
    pair = np.where(side, owner - n, owner)
    order = np.lexsort((side, hashes, pair))
    pair, hashes, weight = pair[order], hashes[order], weight[order]
    both = np.zeros(len(pair), dtype=bool)
    both[:-1] = (pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1])
    at = np.flatnonzero(both)
    shared = np.bincount(pair[at], weights=np.minimum(weight[at], weight[at + 1]), minlength=n)
    total = counts[:n] + counts[n:] - shared
    return np.where(total > 0, shared / np.maximum(total, 1), 0.0)
