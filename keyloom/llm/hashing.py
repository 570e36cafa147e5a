"""Vectorised 64-bit hashing shared by the operators; all values agree between machines and runs."""

import itertools

import numpy as np
import xxhash

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Memo(dict):
    """text -> its 64-bit hash (another one for another seed); emptied when it holds `most` entries, so memory stays bounded."""

    def __init__(self, most: int = 500_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, text: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[text] = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed)
        return h


def flat_hashes(pieces: list[list[str]], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all pieces in order, number of pieces of each list)."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    total = int(sizes.sum())
    return np.fromiter(map(memo.__getitem__, itertools.chain.from_iterable(pieces)), U, total), sizes


def windows(h: np.ndarray, sizes: np.ndarray, w: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, list, position) of each run of w successive pieces of one list."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if len(h) < w:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(h) - w + 1
    ok = np.flatnonzero(owner[:n] == owner[w - 1 :])
    out = np.full(len(ok), U((seed * 2 + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
    for k in range(w):
        out = mix(out + h[ok + k])
    starts = np.cumsum(sizes) - sizes
    return out, owner[ok], ok - starts[owner[ok]]


def blocks(texts: list, most_chars: int = 4_000_000, most: int = 4096):
    """(first, end) of successive blocks of texts, bounded in texts and, but for single long texts, in characters."""
    first = chars = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and (chars + n > most_chars or i - first >= most):
            yield first, i
            first, chars = i, 0
        chars += n
    if first < len(texts):
        yield first, len(texts)
