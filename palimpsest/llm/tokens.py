"""Token ids from a vocabulary file, shared by the token-file writer and the packer."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable

import numpy as np

from palimpsest.llm.shingles import span_hashes

#: Kinds of bytes: white space that only parts words, letters, digits, signs, and all others.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
#: ASCII signs of which a run is one piece; not the apostrophe and < that begin contractions and special tokens.
PLAIN_SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[32, 10]] = SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[[ord(c) for c in PLAIN_SIGNS]] = SIGN
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Latin-1 letters are this byte and one that follows; of those the two signs × and ÷ aren't letters.
_LEAD, _NO_LETTERS = 0xC3, (0x97, 0xB7)
#: Bytes of text whose pieces are found at once, and new pieces that are encoded at once: the room an encoder needs beside its memory.
WINDOW_BYTES, LEARN_PIECES = 1 << 19, 4000


class WordEncoder:
    """Encodes whole texts with the tokenizers library, remembering what it gave for pieces of words.

    For vocabularies that drop white space and split letters, digits and signs before they merge
    (word_bpe_49k): a text's ids are then its words' ids in order, and a plain word's ids those of its
    runs of letters or signs and of its digits. Plain letters are those that the normaliser lower-cases
    one by one; a word with anything else passes through the whole tokenizer as one piece. Pieces are
    found and looked up by 64-bit hash for a window of bytes at once, cut between words, so that a long text needs
    no more room than many short ones; when the memory is full, the pieces that were met most stay, those that were
    met once go.
    """

    def __init__(self, path: str, pieces: int = 300_000, pool_ids: int = 2_400_000, window: int = WINDOW_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.window = window
        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)  # one vocabulary in memory
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.most = (pieces, pool_ids)
        self.keys, self.slots, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begin, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Keeps at most half of the pieces and of the pool that may be held, those met most; their counts are halved."""
        order = np.argsort(-self.met, kind="stable")
        few = (np.arange(len(order)) < self.most[0] // 2) & (np.cumsum(self.count[order]) <= self.most[1] // 2) & (self.met[order] > 1)
        keep = np.zeros(len(self.met), bool)
        keep[order[few]] = True
        own = keep[self.slots]
        self.keys, self.slots = self.keys[own], (np.cumsum(keep) - 1)[self.slots[own]]
        begin, self.count, self.met = self.begin[keep], self.count[keep], self.met[keep] // 2
        ends = np.cumsum(self.count)
        self.begin = ends - self.count
        self.pool = self.pool[np.repeat(begin - self.begin, self.count) + np.arange(int(self.count.sum()))]

    def _pieces(self, data: np.ndarray):
        """(starts, stops, lower-cased bytes, whether odd) of all pieces."""
        lower, kind = _LOWER[data], _KIND[data]
        lead = np.nonzero(data[:-1] == _LEAD)[0]
        if len(lead):
            follow = data[lead + 1]
            lead = lead[(follow != _NO_LETTERS[0]) & (follow != _NO_LETTERS[1])]
            kind[lead] = kind[lead + 1] = LETTER
            upper = lead[data[lead + 1] < 0x9F] + 1
            lower[upper] += 32
        if (kind == OTHER).any():  # the whole word is one odd piece
            word = np.cumsum(kind == SPACE)
            odd = np.zeros(word[-1] + 1, bool)
            odd[word[kind == OTHER]] = True
            kind[odd[word] & (kind != SPACE)] = OTHER
        cut = np.nonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))[0] + 1
        starts, stops = np.concatenate([[0], cut]), np.append(cut, len(data))
        own = kind[starts] != SPACE
        starts, stops = starts[own], stops[own]
        return starts, stops, lower, kind[starts] == OTHER

    def _learn(self, keys: np.ndarray, texts: list[str], odd: np.ndarray) -> np.ndarray:
        """Slots of new pieces, whose ids join the pool."""
        found: list = [None] * len(texts)
        for tokenizer, own in ((self.merges, np.nonzero(~odd)[0].tolist()), (self.whole, np.nonzero(odd)[0].tolist())):
            for at in range(0, len(own), LEARN_PIECES):
                part = own[at : at + LEARN_PIECES]
                for i, e in zip(part, tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                    found[i] = e.ids
        count = np.array([len(x) for x in found], np.int64)
        slots = len(self.count) + np.arange(len(texts))
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.met = np.concatenate([self.met, np.zeros(len(count), np.int64)])
        self.pool = np.concatenate([self.pool, np.array([i for x in found for i in x], np.uint32)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        return slots

    def _windows(self, data: np.ndarray):
        """(begin, end) of windows that end in white space; longer than the bound only for a longer word."""
        ends = np.nonzero(_KIND[data] == SPACE)[0] + 1
        at = 0
        while at < len(data):
            last = int(np.searchsorted(ends, at + self.window, "right")) - 1
            stop = int(ends[max(last, np.searchsorted(ends, at, "right"))])
            yield at, stop
            at = stop

    def _ids(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(starts of a window's pieces, number of ids of each, all ids)."""
        if len(self.keys) > self.most[0] or len(self.pool) > self.most[1]:
            self._forget()
        starts, stops, lower, odd = self._pieces(data)
        keys = span_hashes(lower, starts, stops)
        for i in np.nonzero(odd)[0].tolist():
            keys[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : stops[i]], digest_size=8).digest(), "little")
        one, first, which, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, one)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == one if len(self.keys) else np.zeros(len(one), bool)
        slot = np.empty(len(one), np.int64)
        slot[known] = self.slots[at[known]]
        new = np.nonzero(~known)[0]
        if len(new):
            place = first[new]
            text = [(data if o else lower)[a:b].tobytes().decode() for a, b, o in zip(starts[place].tolist(), stops[place].tolist(), odd[place].tolist(), strict=True)]
            slot[new] = self._learn(one[new], text, odd[place])
        self.met[slot] += times
        slot = slot[which]
        n = self.count[slot]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.begin[slot] - (ends - n), n) + np.arange(int(n.sum()))]
        return starts, n, ids.astype("<u4").tobytes()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; a null text has none."""
        raw = [(t or "").encode() + b" " for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return []
        starts, counts, parts = [], [], []
        for at, stop in self._windows(data):
            begin, n, ids = self._ids(data[at:stop])
            starts.append(begin + at)
            counts.append(n)
            parts.append(ids)
        ids = b"".join(parts)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        bounds = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
        cuts = (4 * ends[np.searchsorted(np.concatenate(starts), bounds)]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker process's encoder for that vocabulary file; it outlives single tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
