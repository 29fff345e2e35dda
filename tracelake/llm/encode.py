"""Exact tokenizer output at corpus speed: texts are cut where no token can cross, pieces are remembered.

For the vocabularies of ``tokenizers`` files a chunk of texts is cut by array operations over its UTF-8 bytes
(``cuts``), its pieces are numbered by Arrow's dictionary encoding, and ids are gathered by number; Python
sees each distinct piece of a chunk once. For ``sentencepiece`` models a text is cut before single spaces when
neither neighbour of the space is white space (or another sign that a vocabulary can join with a space).

A worker remembers the ids of short pieces, ``MEMO`` of them at most. The library encodes what is not
remembered: Latin words by its model alone, for they are one word to it, and all others as texts of their own.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tracelake.llm.common import ascii_lower

MEMO = 800_000
LONGEST = 48
_LOWER = ascii_lower().tobytes()
#: White space of any kind and signs that vocabularies join with a space.
_UNSAFE = "\\s\u2581\u180e\u200b\ufeff"
_SAFE = re.compile(f"(?<=[^{_UNSAFE}]) (?=[^{_UNSAFE}])")


def _plain(text: str) -> bool:
    """Whether every space of ``text`` is safe: printable signs, single spaces and line ends away from spaces."""
    return not (
        "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
        or "\u2581" in text or not text.replace("\n", "").isprintable()
    )


def pieces(text: str) -> list[str]:
    """``text`` split at its safe spaces; each space belongs to the piece after it and is left out."""
    return text.split(" ") if _plain(text) else _SAFE.split(text)


class Encoder:
    """Looks up what ``encode`` returns for pieces; ``first`` and later pieces are kept apart."""

    def __init__(self, encode_first, encode_later, memo: int = MEMO, split=pieces):
        self._split = split
        self._encode = (encode_first, encode_later)
        self._known: tuple[dict, dict] = ({}, {})
        self._older: tuple[dict, dict] = ({}, {})
        self._memo = memo

    def _table(self, words: set[str], kind: int) -> dict:
        """What each of ``words`` encodes to; the words of one batch, so of bounded size."""
        known, older = self._known[kind], self._older[kind]
        table = {w: v for w in words if (v := known.get(w)) is not None}
        if len(table) == len(words):
            return table
        fresh = {w: older.get(w) for w in words if w not in table}
        missing = [w for w, v in fresh.items() if v is None]
        if missing:
            fresh.update(zip(missing, self._encode[kind](missing)))
        table.update(fresh)
        short = {w: v for w, v in fresh.items() if len(w) <= LONGEST}
        if len(known) + len(short) > self._memo // 2:
            older.clear()
            older.update(known)
            known.clear()
        if len(short) <= self._memo // 2:
            known.update(short)
        return table

    def __call__(self, texts: list[str]) -> list[list]:
        """For each text, what its pieces encode to, in turn."""
        split = [self._split(t) for t in texts]
        if self._encode[0] is self._encode[1]:
            at = self._table(set().union(*split), 1).__getitem__
            return [list(map(at, p)) for p in split]
        heads = [p.pop(0) for p in split]
        first = self._table(set(heads), 0)
        at = self._table(set().union(*split), 1).__getitem__
        return [[first[h], *map(at, p)] for h, p in zip(heads, split)]


#: Classes of the byte that ends a sign: white space, letter, mark that may be cut off, other sign that is no white space.
_WHITE, _LETTER, _MARK, _OTHER = 1, 2, 3, 4


def _classes() -> bytes:
    out = np.zeros(256, np.uint8)
    out[0x21:0x7F] = _MARK
    out[0x30:0x3A] = _OTHER
    out[0x41:0x5B] = out[0x61:0x7B] = _LETTER
    out[[0x27, 0x7C]] = _OTHER  # apostrophes begin contractions, bars stand in special strings
    out[[9, 10, 11, 12, 13, 32]] = _WHITE
    return out.tobytes()


def _pairs() -> bytes:
    """For 8 * class + class of the next byte: whether a piece begins between them."""
    out = bytearray(256)
    for before, here in ((_LETTER, _WHITE), (_MARK, _WHITE), (_OTHER, _WHITE), (_LETTER, _MARK), (_MARK, _LETTER)):
        out[8 * before + here] = 1
    return bytes(out)


_CLASSES, _PAIRS = _classes(), _pairs()


def cuts(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at the texts' beginnings and where every vocabulary of a ``tokenizers`` file begins a new token.

    That is before white space that follows another sign, after a single line end between other signs, and
    between a Latin letter and an ASCII mark (apostrophes and bars are left alone). Signs of unknown class - controls and
    those of blocks with white space of their own - have no cut beside them.
    """
    raw, kind = np.frombuffer(data, np.uint8), np.frombuffer(bytearray(data.translate(_CLASSES)), np.uint8)
    high = np.flatnonzero(raw >= 0xC3)
    if len(high):
        lead, after = raw[high], raw[np.minimum(high + 1, len(raw) - 1)]
        letter = (lead < 0xCA) & ~((lead == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((lead == 0xC4) & (after == 0xB0)) & ~((lead == 0xC9) & (after >= 0x90))
        own = high[letter]  # both bytes are of the class, so that no cut is within
        kind[own] = kind[own + 1] = _LETTER
        for least, most, size in ((0xC3, 0xDF, 2), (0xE4, 0xEC, 3), (0xF0, 0xF4, 4)):
            kind[high[~letter & (lead >= least) & (lead <= most)] + size - 1] = _OTHER
    begin = np.zeros(len(raw) + 1, np.uint8)
    begin[1:-1] = np.frombuffer((kind[:-1] * np.uint8(8) + kind[1:]).tobytes().translate(_PAIRS), np.uint8)
    ends = np.flatnonzero(raw[1:-1] == 10) + 1
    begin[ends[(kind[ends - 1] >= _LETTER) & (kind[ends + 1] >= _LETTER)] + 1] = 1
    begin[offsets] = 1
    return np.flatnonzero(begin[: len(raw)].view(bool))


#: Letters that are one sign in every normal form and in either case; words of them are one word to every vocabulary.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies have for each byte: itself if printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_SIGNS = _byte_signs()


class IdEncoder:
    """Ids of whole texts by a ``tokenizers`` file. ``keeps_space``: whether the space before a piece is part of its first token."""

    def __init__(self, path: str, keeps_space: bool, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._model = self._library.model
        self._keeps_space, self._memo = keeps_space, memo
        self._forget()

    def _forget(self) -> None:
        """Pieces by number; the ids of piece k are ids[ends[k]:ends[k + 1]]."""
        self._known: dict[bytes, int] = {}
        self._ids, self._ends, self._count, self._used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def _word(self, piece: bytes) -> str | None:
        """The piece as the library's model sees it, if it is one Latin word; None leaves it to the whole library."""
        space = self._keeps_space and piece[:1] == b" "
        own = piece[1:] if space else piece if self._keeps_space else piece.lstrip(b" ")
        if not own.isalpha():  # of ASCII letters
            text = own.decode()
            if not _LATIN.fullmatch(text):
                return None
            own = (text if self._keeps_space else text.lower()).encode()
        elif not self._keeps_space:
            own = own.lower()
        word = own.decode("latin-1").translate(_SIGNS) if not own.isascii() else own.decode()
        return _SIGNS[32] + word if space else word

    def _encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, in turn, and their numbers. Words go straight to the library's model, all others through the library."""
        words = list(map(self._word, pieces))
        rest = iter(self._library.encode_batch_fast([p.decode() for p, w in zip(pieces, words) if w is None], add_special_tokens=False))
        tokenize, ids, sizes = self._model.tokenize, [], []
        for w in words:
            own = next(rest).ids if w is None else [t.id for t in tokenize(w)]
            ids += own
            sizes.append(len(own))
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each of the distinct pieces of a chunk; unknown ones are encoded."""
        known = self._known
        out = list(map(known.get, pieces))
        missing = [k for k, v in enumerate(out) if v is None]
        if not missing:
            return np.array(out, np.int64)
        if self._count and (self._count + len(missing) > self._memo or self._used > 8 * self._memo):
            self._forget()
            return self._numbers(pieces)
        fresh = [pieces[k] for k in missing]
        ids, sizes = self._encode_all(fresh)
        while self._used + len(ids) > len(self._ids):
            self._ids = np.append(self._ids, np.zeros_like(self._ids))
        while self._count + len(fresh) + 1 > len(self._ends):
            self._ends = np.append(self._ends, np.zeros_like(self._ends))
        self._ids[self._used : self._used + len(ids)] = ids
        self._ends[self._count + 1 : self._count + len(fresh) + 1] = self._used + np.cumsum(sizes)
        numbers = range(self._count, self._count + len(fresh))
        self._known.update(x for x in zip(fresh, numbers) if len(x[0]) <= LONGEST)
        for k, v in zip(missing, numbers):
            out[k] = v
        self._used, self._count = self._used + len(ids), self._count + len(fresh)
        return np.array(out, np.int64)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end_id`` after it, and the n+1 bounds of the texts in them."""
        if not len(raw):
            none = np.zeros(0, np.uint32)
            return (none, np.zeros(len(offsets), np.int64)) if end_id is None else (np.full(len(offsets) - 1, end_id, np.uint32), np.arange(len(offsets)))
        data = raw.tobytes()
        if not self._keeps_space and b"<|" not in data:
            data = data.translate(_LOWER)  # as the library does; a special string that would come to be holds "<|"
        begin = cuts(data, offsets)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        number = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        first = self._ends[number]
        size = self._ends[number + 1] - first
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self._ids[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        bounds = before[np.searchsorted(begin, offsets)]
        if end_id is None:
            return ids, bounds
        bounds = bounds + np.arange(len(bounds))
        out = np.empty(int(bounds[-1]), np.uint32)
        inner = np.ones(len(out), bool)
        inner[bounds[1:] - 1] = False
        out[inner], out[~inner] = ids, end_id
        return out, bounds


@lru_cache(maxsize=1)
def id_encoder(path: str, keeps_space: bool, memo: int = MEMO) -> IdEncoder:
    """A worker keeps one encoder."""
    return IdEncoder(path, keeps_space, memo)


@lru_cache(maxsize=4)
def length_encoder(path: str) -> Encoder:
    """Pieces to token counts by a ``sentencepiece`` model; its dummy prefix stands for the space before a piece."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(words: list[str]) -> list[int]:
        return [len(ids) for ids in library.encode(words, num_threads=1)]

    return Encoder(encode, encode)
