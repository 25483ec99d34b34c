"""Simple-8b coding of token ids in blocks, with numpy over all blocks at once."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the coding: selector k packs COUNTS[k] ids of WIDTHS[k] bits in the low 60 bits of a word.
#: The last selector is the escape: one id of up to 60 bits.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 256
MAGIC = b"S8B1"
#: Bits of the ids below 65,536.
SHORT_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
HEAD = struct.Struct("<4sIQQQQ")


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): block b is words[offsets[b]:offsets[b + 1]]; each block starts a word."""
    n = len(ids)
    if n and int(ids.max()) >= 1 << 60:
        raise ValueError("an id needs more than 60 bits")
    rows = -(-n // block)
    padded = np.zeros((rows, block + 60), np.uint64)
    flat = np.zeros(rows * block, np.uint64)
    flat[:n] = ids
    padded[:, :block] = flat.reshape(rows, block)
    length = np.full(rows, block)
    if rows:
        length[-1] = n - (rows - 1) * block
    best = np.full((rows, block), len(COUNTS) - 1, np.int8)
    bits = np.frexp(padded.astype(np.float64))[1].astype(np.uint8) if n and ids.max() >= 1 << 16 else SHORT_BITS[padded.astype(np.uint16)]
    for k in range(len(COUNTS) - 2, -1, -1):  # later ones pack more
        before = np.zeros((rows, block + 61), np.uint8)  # counts of wider ids modulo 256; a word holds 60 at most
        np.cumsum(bits > WIDTHS[k], axis=1, out=before[:, 1:], dtype=np.uint8)
        best[before[:, COUNTS[k] : COUNTS[k] + block] == before[:, :block]] = k
    at, row, found = np.zeros(rows, np.int64), np.arange(rows), []
    while len(row):  # one word of every unfinished block
        chosen = best[row, at]
        found.append((row, at, chosen))
        at = at + COUNTS[chosen]
        more = at < length[row]
        row, at = row[more], at[more]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    row, at, chosen = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, row))
    row, at, chosen = row[order], at[order], chosen[order]
    words = chosen.astype(np.uint64) << np.uint64(60)
    source = padded.reshape(-1)
    for k, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        own = np.nonzero(chosen == k)[0]
        first = row[own] * (block + 60) + at[own]
        for j in range(count):
            words[own] |= source[first + j] << np.uint64(j * width)
    return words, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.uint32)


def decode_blocks(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of encode_blocks."""
    rows = len(offsets) - 1
    chosen = (words >> np.uint64(60)).astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(offsets.astype(np.int64)))
    ends = np.cumsum(COUNTS[chosen]) if len(words) else np.zeros(0, np.int64)
    starts = ends - COUNTS[chosen]
    first = starts[offsets[:-1].astype(np.int64)] if rows else starts
    out = np.zeros((rows, block + 60), np.uint64)
    flat, base = out.reshape(-1), row * (block + 60) + starts - (first[row] if rows else 0)
    for k, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        own = np.nonzero(chosen == k)[0]
        mask = np.uint64((1 << int(width)) - 1)
        for j in range(count):
            flat[base[own] + j] = (words[own] >> np.uint64(j * width)) & mask
    return out[:, :block].reshape(-1)[:n]


def pack_file(doc_ids: list[int | None], ids: list[bytes], part: int, start: int) -> bytes:
    """One file: head, the documents' ids and token counts, block offsets, words."""
    tokens = np.frombuffer(b"".join(ids), "<u4")
    words, offsets = encode_blocks(tokens)
    known = np.array([d is not None for d in doc_ids], "u1")
    return b"".join((
        HEAD.pack(MAGIC, len(offsets) - 1, len(doc_ids), len(tokens), part, start), known.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(b) // 4 for b in ids], "<i8").tobytes(),
        offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def unpack_file(data: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """(part, start, document ids, token counts, all ids) of one file."""
    magic, blocks, docs, n, part, start = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    known = np.frombuffer(data, "u1", docs, at)
    doc_ids = np.frombuffer(data, "<i8", docs, at + docs)
    counts = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    offsets = np.frombuffer(data, "<u4", blocks + 1, at + 17 * docs)
    words = np.frombuffer(data, "<u8", -1, at + 17 * docs + 4 * (blocks + 1))
    return part, start, [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], counts, decode_blocks(words, offsets, n).astype("<u4")
