"""Token ids of whole texts with a public tokenizer file, in Arrow batches.

The vocabulary lower-cases, drops white space and never merges across pieces (words, single
digits, runs of signs), so a piece has the same ids wherever it stands. Texts of plain Latin
characters are cut into pieces and each different piece is encoded once per worker; any other
text, and any text that holds a special token's opening, goes through the tokenizer as a whole.
Both ways give the ids of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from adkpi.llm.text import buffers, ragged, range_hashes

_CACHED_PIECES = 400_000
_SLOTS = 1 << 21
_PIECES_AT_ONCE = _SLOTS // 4  # a longer text is encoded in parts
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of every character up to U+024F that is cut here.

    Characters whose case, spacing or composition rules differ between libraries are left to
    the tokenizer: control characters, NEL, no-break space, soft hyphen, dotted capital I, and
    those whose lower case takes another number of bytes.
    """
    kind = np.full(0x250, _OTHER, np.uint8)
    lower = np.arange(0x250, dtype=np.uint16)
    for code in (0x20, 0x09, 0x0A, 0x0D):
        kind[code] = _SPACE
    for code in range(0x21, 0x250):
        small = chr(code).lower()
        if 0x7F <= code <= 0xA0 or code in (0xAD, 0x130) or len(small) > 1 or ord(small) >= 0x250:
            continue
        group = unicodedata.category(chr(code))[0]
        kind[code] = {"L": _LETTER, "N": _DIGIT}.get(group, _SIGN)
        lower[code] = ord(small)
    return kind, lower


_KIND, _LOWER = _tables()


def cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-case bytes, start and end of every piece, its text, and texts not cut here."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return raw, none, none, none, np.zeros(len(offsets) - 1, bool)
    kind, low = _KIND[np.minimum(raw, 0x80)], _LOWER[:128].astype(np.uint8)[raw & 127]
    high = np.flatnonzero(raw >= 0x80)
    if len(high):
        low[high] = raw[high]
        lead = high[(raw[high] >= 0xC2) & (raw[high] < 0xCA)]
        code = ((raw[lead].astype(np.uint16) & 31) << 6) | (raw[lead + 1] & 63)
        known = code < 0x250
        lead, code = lead[known], code[known]
        kind[high] = _OTHER
        kind[lead] = kind[lead + 1] = _KIND[code]
        small = _LOWER[code]
        low[lead], low[lead + 1] = 0xC0 | (small >> 6), 0x80 | (small & 63)
    other = np.flatnonzero(kind == _OTHER)
    marked = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))  # "<|" opens special tokens
    strange = np.zeros(len(offsets) - 1, bool)
    strange[np.searchsorted(offsets, np.concatenate((other, marked)), "right") - 1] = True
    # A piece begins where the kind changes, and at every digit's first byte.
    begins = np.ones(len(raw), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins |= (kind == _DIGIT) & ((raw & 0xC0) != 0x80)
    firsts = offsets[:-1]
    begins[firsts[firsts < len(raw)]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(raw))
    used = kind[start] != _SPACE
    start, end = start[used], end[used]
    owner = np.searchsorted(offsets, start, "right") - 1
    # 's 't 'm 'd 're 've 'll: a lone apostrophe takes one or two letters that follow.
    lone = np.flatnonzero((low[start[:-1]] == 39) & (end[:-1] - start[:-1] == 1))
    lone = lone[
        (end[lone] == start[lone + 1])
        & (kind[start[lone + 1]] == _LETTER)
        & (owner[lone] == owner[lone + 1])
    ]
    if len(lone):
        one = low[start[lone + 1]]
        two = np.where(
            end[lone + 1] - start[lone + 1] > 1, low[np.minimum(start[lone + 1] + 1, len(raw) - 1)], 0
        )
        takes = np.where(np.isin(one, list(b"stmd")), 1, 0)
        for a, b in (b"re", b"ve", b"ll"):
            takes[(one == a) & (two == b)] = 2
        end[lone] += takes
        start[lone + 1] += takes
        left = start < end
        start, end, owner = start[left], end[left], owner[left]
    keep = ~strange[owner]
    return low, start[keep], end[keep], owner[keep], strange


class Encoder:
    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(vocabulary)
        # Pieces are already lower case; only bytes and merges are left to do.
        self._bare = Tokenizer.from_file(vocabulary)
        self._bare.normalizer = normalizers.Sequence([])
        self._bare.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        pieces = self.whole.get_vocab()
        self.size = max(pieces.values()) + 1
        self._ends_piece = np.zeros(self.size, bool)
        self.ends_sentence = np.zeros(self.size, bool)
        for piece, number in pieces.items():
            self._ends_piece[number] = piece.endswith("</w>")
            sign = piece.removesuffix("</w>")
            self.ends_sentence[number] = sign[-1:] in (".", "!", "?") and piece.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        # Open addressing over 64-bit hashes of pieces; a free slot holds number -1.
        self._key = np.zeros(_SLOTS, np.uint64)
        self._number = np.full(_SLOTS, -1, np.int32)
        self._pieces = 0
        self._ids = np.zeros(1 << 16, np.uint32)
        self._used = 0
        self._start = np.zeros(1 << 14, np.int64)
        self._length = np.zeros(1 << 14, np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each key (-1: unknown) and the slot where the search ended."""
        slot = (keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        number = self._number[slot]
        open_ = np.flatnonzero((number >= 0) & (self._key[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (_SLOTS - 1)
            at = slot[open_]
            number[open_] = self._number[at]
            open_ = open_[(number[open_] >= 0) & (self._key[at] != keys[open_])]
        return number, slot

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces, all different, and keep their ids."""
        texts = [" ".join(pieces[at : at + 256]) for at in range(0, len(pieces), 256)]
        found = self._bare.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for e in found])
        ends = np.flatnonzero(self._ends_piece[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the vocabulary does not mark the end of every piece")
        first, count = self._pieces, len(pieces)
        while self._used + len(ids) > len(self._ids):
            self._ids = np.resize(self._ids, 2 * len(self._ids))
        while first + count > len(self._start):
            self._start = np.resize(self._start, 2 * len(self._start))
            self._length = np.resize(self._length, 2 * len(self._length))
        self._ids[self._used : self._used + len(ids)] = ids
        starts = np.concatenate(([0], ends[:-1]))
        self._start[first : first + count] = self._used + starts
        self._length[first : first + count] = ends - starts
        self._used += len(ids)
        self._pieces += count
        waiting = np.arange(count)
        while len(waiting):
            slot = self._find(keys[waiting])[1]
            slot, winner = np.unique(slot, return_index=True)  # one new key per free slot
            placed = waiting[winner]
            self._key[slot] = keys[placed]
            self._number[slot] = first + placed
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)

    def _encode_pieces(
        self, low: np.ndarray, start: np.ndarray, end: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and the number of ids of each."""
        keys = range_hashes(low, start, end)
        which = self._find(keys)[0]
        unknown = np.flatnonzero(which < 0)
        if len(unknown):
            new, at = np.unique(keys[unknown], return_index=True)
            at = unknown[at]
            if self._pieces + len(new) > max(_CACHED_PIECES, len(new)):
                self._forget()
                new, at = np.unique(keys, return_index=True)
            data = low.tobytes()
            self._learn(new, [data[i:j].decode() for i, j in zip(start[at], end[at])])
            which = self._find(keys)[0]
        lengths = self._length[which]
        return self._ids[ragged(self._start[which], lengths)], lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each; NULL is empty text."""
        raw, offsets = buffers(texts)
        low, start, end, owner, strange = cut(raw, offsets)
        if not len(start) and not strange.any():
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        found = [
            self._encode_pieces(low, start[at : at + _PIECES_AT_ONCE], end[at : at + _PIECES_AT_ONCE])
            for at in range(0, len(start), _PIECES_AT_ONCE)
        ]
        none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, lengths = (np.concatenate(parts) for parts in zip(*(found or [none])))
        counts = np.bincount(owner, lengths, len(texts)).astype(np.int64)
        if strange.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for row in np.flatnonzero(strange):
                own = self.whole.encode(texts[int(row)].as_py(), add_special_tokens=False).ids
                parts[row] = np.asarray(own, np.uint32)
                counts[row] = len(own)
            ids = np.concatenate(parts)
        return ids, counts


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(vocabulary)


def with_end_id(
    ids: np.ndarray, counts: np.ndarray, end_id: int
) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each document."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
