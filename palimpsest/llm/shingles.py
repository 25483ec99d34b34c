"""Words, word shingles and minwise hashes of whole batches of texts, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
_U = np.uint64
_random = np.random.default_rng(20240501)
#: Code of each byte; A-Z have those of a-z.
_CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_CODES[65:91] = _CODES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = int(_random.integers(1, 1 << 62)) * 2 + 1
_PLACES = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | _U(1)
HASHES = 128
_MULTIPLY = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) | _U(1)
_ADD = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_powers: dict[bool, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    """_BASE (or its inverse) to the powers below n, modulo 2 to the 64; kept if there aren't too many."""
    if inverse in _powers and len(_powers[inverse]) >= n:
        return _powers[inverse][:n]
    steps = np.full(max(n, 1 << 20), pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
    steps[0] = 1
    found = np.multiply.accumulate(steps)
    if len(found) <= 1 << 20:
        _powers[inverse] = found
    return found[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever it stands; A-Z hash as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _power(len(data), False), out=sums[1:])
    return mix((sums[stops] - sums[starts]) * _power(len(data) + 1, True)[starts])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each lower-cased word, the number of words of each text); null texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    starts = np.nonzero(inside & (before | edge[:-1]))[0]
    stops = np.nonzero(inside & (after | edge[1:]))[0] + 1
    return span_hashes(data, starts, stops), np.diff(np.searchsorted(starts, ends))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the texts' different shingle hashes, sorted within each text; the size of each text's set).

    A text of fewer words than SHINGLE has its whole sequence as one shingle, one without words none.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    first = ends - counts
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    stops = np.cumsum(sizes)
    begin = stops - sizes
    at = np.arange(stops[-1] if len(stops) else 0) - np.repeat(begin, sizes) + np.repeat(first, sizes)
    long = np.repeat(np.minimum(counts, SHINGLE), sizes)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    out = long.astype(np.uint64)
    for j in range(SHINGLE):
        out += np.where(long > j, padded[at + j] * _PLACES[j], _U(0))
    out = mix(out)
    for a, b in zip(begin[sizes > 1].tolist(), stops[sizes > 1].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[sizes > 0]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return out[new], total[stops] - total[begin]


def set_keys(sets: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128 bits that two sets share only if they are equal; None for an empty set."""
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ _U(salt)))]) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    ends = np.cumsum(sizes)
    both = np.stack([mix(t[ends] - t[ends - sizes]) for t in total], axis=1)
    raw = both.tobytes()
    return [raw[16 * i : 16 * i + 16] if n else None for i, n in enumerate(sizes.tolist())]


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """HASHES minwise hashes of 32 bits for each set that isn't empty, in order."""
    some = sizes[sizes > 0]
    out = np.empty((len(some), HASHES), np.uint32)
    if len(some):
        begin = np.cumsum(some) - some
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(((sets * _MULTIPLY[k] + _ADD[k]) >> _U(32)).astype(np.uint32), begin)
    return out
