"""64-bit hashes of words and of runs of words, over whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; the arrays of a chunk then stay small.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(64).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash's base and of its inverse, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, CHUNK_BYTES + 1)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as bytes, about `limit` bytes of them at once, with the number of the first; null is empty."""
    first, size, held = 0, 0, []
    for i in range(len(texts)):
        data = texts[i].as_py()
        data = b"" if data is None else data.encode()
        if held and size + len(data) > limit:
            yield first, held
            first, size, held = i, 0, []
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


def words(texts: list[bytes], powers: Powers, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes other than ASCII white space) of the texts one after another, and the number
    of words before each text and at the end. A-Z count as a-z if lower is set."""
    buffer = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[buffer]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    text_at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, text_at)
    values = (_VALUES[_LOWER] if lower else _VALUES)[buffer]
    up, down = powers(len(buffer) + 1)
    sums = np.cumsum(values * up[: len(buffer)])
    hashes = (sums[ends - 1] - sums[starts - 1]) * down[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the runs of `width` words of each text; of a shorter text, that of all its words."""
    factors = [np.uint64(f) for f in np.random.default_rng(width).integers(1, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)]
    runs = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for i, f in enumerate(factors):
        runs += hashes[i : i + len(runs)] * f
    runs = mixed(runs)
    out = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low >= width:
            own = np.sort(runs[low : high - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif high > low:
            own = (hashes[low:high] * np.array(factors[: high - low])).sum(dtype=np.uint64)
            out.append(mixed(np.array([own]) + np.uint64(high - low)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
