"""Hashed sets of word shingles, computed over the bytes of whole Arrow batches with numpy."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, _U(base & (2**64 - 1)))
        out[0] = 1
        return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without white space, A-Z lower-cased) of texts that lie one after the other in data, and how many words start before each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = FOLD[data]
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:n]
    first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    base = 0xD1342543DE82EF95
    with np.errstate(over="ignore"):
        powers = _powers(base, n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + _U(1)) * powers, out=sums[1:])
        back = _powers(pow(base, -1, 2**64), n)
        words = mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64) * _ODD)
    return words, np.searchsorted(first, offsets)


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    words, at = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        weights = [mix(_U(i + 1) * _ODD + np.zeros(1, np.uint64))[0] | _U(1) for i in range(k)]
        m = max(0, len(words) - k + 1)
        whole = np.zeros(m, np.uint64)
        for i in range(k):
            whole += words[i : i + m] * weights[i]
        whole = mix(whole)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(whole[a : b - k + 1]))
            elif b > a:
                short = np.zeros(1, np.uint64)
                for i in range(b - a):
                    short += words[a + i] * weights[i]
                out.append(mix(short + _U(b - a) * _ODD))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(column, k: int = 5):
    """Yields for each text of an Arrow string column its sorted distinct shingle hashes: of k words each, or of all words where there are fewer."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
        b = min(b, len(column))
        yield from _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
        a = b


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))
