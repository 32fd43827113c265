"""Whole-text encoding with the tokenizers library, each distinct chunk once.

Byte-level BPE never merges across a space or a line end that a non-space follows, nor from a letter
to a mark, so a text may be cut there and the ids of its chunks joined. Arrow numbers the chunks of
many texts and lays their ids side by side; a worker keeps a bounded store of the chunks it has met;
the library itself encodes every new one. The results equal encoding the whole text at once.
"""

from __future__ import annotations

import os
from codecs import charmap_decode
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa

from lodestone.llm.common import byte_column

#: Chunks in a generation of a worker's store (it keeps two), and the longest that is kept.
STORE, LONGEST = 200_000, 48
#: Bytes of texts that are looked up together.
PART = 4_000_000
#: New chunks in one string for the library, whose time on longer ones grows faster than they do, and strings in a call.
LUMP, CALL = 64, 256

_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters that stand for the 256 bytes in a byte-level vocabulary.
BYTES = {b: chr(b) for b in _shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _shown)}
_spelling = "".join(BYTES[b] for b in range(256))
_byte_of = {c: b for b, c in BYTES.items()}


def _table(*ranges: range) -> np.ndarray:
    """For each byte, whether it is in one of the ranges."""
    held = np.zeros(256, bool)
    for r in ranges:
        held[r.start : r.stop] = True
    return held


_ends = _table(range(10, 11), range(32, 33))
_blank = _table(range(33))
_ascii = _table(range(33, 127))
_letter = _table(range(65, 91), range(97, 123))
_marks = _ascii & ~_letter & ~_table(range(48, 58))
#: Bytes that surely begin a character which is no white space.
_solid = _ascii | _table(range(0xC3, 0xE0), range(0xE4, 0xEF), range(0xF0, 0xF5))
#: Second bytes of the letters from U+00C0 to U+00FF, whose first is C3.
_second = _table(range(0x80, 0xC0)) & ~_table(range(0x97, 0x98), range(0xB7, 0xB8))
#: Bytes of ASCII letters and of those.
_latin = _letter | _second | _table(range(0xC3, 0xC4))


def joins_words(piece: str) -> bool:
    """Whether a piece of the vocabulary reaches over a space or a line end and holds more than white space."""
    if not ({"Ġ", "Ċ"} & set(piece[1:]) or piece[:1] == "Ċ" and len(piece) > 1):
        return False
    raw = bytes(_byte_of[c] for c in piece if c in _byte_of)
    return not raw.decode("utf-8", "replace").isspace()


def cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin in their bytes, and after them where the last ends; ``offsets``: of each text and the end.

    A space or line end begins a chunk if a character that is no white space follows in its text, or
    an ASCII one stands before it; so does an ASCII mark after a letter.
    """
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    at = np.flatnonzero(_ends[data])
    follows = _solid[data.take(at + 1, mode="clip")] & ~begins[at + 1]
    begins[at[follows | _ascii[data[at - 1]]]] = True
    at = np.flatnonzero(_marks[data])
    before = data[at - 1]
    begins[at[_letter[before] | _second[before] & (data.take(at - 2, mode="wrap") == 0xC3)]] = True
    return np.flatnonzero(begins)


class ChunkEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers, ``encode_each(texts)`` those of each text."""

    def __init__(self, tokenizer_json: str, store: int | None = None):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; waking the library's threads costs more
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.begins[i] = piece.startswith("Ġ") or piece == "Ċ"
        #: The model without the pattern: alike on letters between single spaces or line ends, if no piece joins them.
        self.words = None if any(map(joins_words, vocab)) else Tokenizer(self.tokenizer.model)
        self.limit = store or STORE
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode_singly(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_joined(self, chunks: pa.Array, tokenizer, spelt: Callable[[bytes], str]) -> list[bytes]:
        """The ids of chunks that each begin with a space or line end and have no other."""
        data, offsets = byte_column(chunks)
        raw, out = data.tobytes(), []
        for at in range(0, len(chunks), LUMP * CALL):
            n = min(LUMP * CALL, len(chunks) - at)
            ends = [*offsets[at : at + n : LUMP].tolist(), int(offsets[at + n])]
            lumps = [spelt(raw[a:b]) for a, b in zip(ends, ends[1:])]
            lists = [e.ids for e in tokenizer.encode_batch_fast(lumps, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(lists), "<u4", sum(map(len, lists)))
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == n:
                held, places = ids.tobytes(), (4 * starts).tolist()
                out += map(held.__getitem__, map(slice, places, [*places[1:], None]))
            else:
                out += self._encode_singly(chunks.slice(at, n).to_pylist())
        return out

    def _encode_new(self, chunks: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """Places of chunks and the ids of each, by kinds of chunks."""
        data, offsets = byte_column(chunks)
        starts = offsets[:-1]
        several = np.diff(offsets) > 1
        alone = _ends[data[starts]] & several & _solid[data.take(starts + 1, mode="clip")]
        alone &= np.add.reduceat(_blank[data], starts, dtype=np.int64) == 1
        word = alone & (np.add.reduceat(~_latin[data], starts, dtype=np.int64) == 1) & (self.words is not None)
        for kind, encode in (
            (word, lambda x: self._encode_joined(x, self.words, lambda raw: charmap_decode(raw, "strict", _spelling)[0])),
            (alone & ~word, lambda x: self._encode_joined(x, self.tokenizer, bytes.decode)),
            (~alone, lambda x: self._encode_singly(x.to_pylist())),
        ):
            if kind.any():
                at = np.flatnonzero(kind)
                yield at, encode(chunks.take(pa.array(at)))

    def _look_up(self, chunks: pa.Array) -> list[bytes]:
        """The ids of each of the distinct chunks."""
        if len(self.store) > self.limit:
            self.store, self.older = {}, self.store
        names = chunks.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        found = list(map(self.store.get, names))
        places = [i for i, ids in enumerate(found) if ids is None]
        if self.older:
            for i in places:
                ids = found[i] = self.older.get(names[i])
                if ids is not None:
                    self.store[names[i]] = ids
            places = [i for i in places if found[i] is None]
        if places:
            for at, new in self._encode_new(chunks.take(pa.array(places))):
                for i, ids in zip(map(places.__getitem__, at.tolist()), new):
                    found[i] = ids
                    if len(names[i]) <= LONGEST:
                        self.store[names[i]] = ids
        return found

    def _encode_part(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie side by side, and where those of each begin and the last end."""
        places = cut(data, offsets)
        chunks = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        held = pa.array(self._look_up(chunks.dictionary), pa.large_binary()).take(chunks.indices)
        ids, ends = byte_column(held)
        return ids.view("<u4"), ends[np.searchsorted(places, offsets)] // 4

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of texts part by part: those of some texts, and where each text's begin and the last end; a null has none."""
        data, offsets = byte_column(texts)
        at = 0
        while at < len(texts):
            end = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART))))
            yield self._encode_part(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end

    def encode_each(self, texts: pa.Array | Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn; a null has none."""
        for column in [texts] if isinstance(texts, pa.Array) else columns(texts):
            for ids, ends in self.encode_column(column):
                raw, places = ids.tobytes(), (4 * ends).tolist()
                yield from map(raw.__getitem__, map(slice, places, places[1:]))

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_each([text]))


def columns(texts: Iterable[str | None]) -> Iterator[pa.Array]:
    """Texts as Arrow columns of about PART characters."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= PART:
            yield pa.array(part, pa.large_string())
            part, size = [], 0
    yield pa.array(part, pa.large_string())


_encoders: dict[tuple[int, int | None], ChunkEncoder] = {}


def encoder_for(tokenizer_json: str, store: int | None = None) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file's content, with ``store`` chunks in a generation (default: STORE)."""
    key = hash(tokenizer_json), store
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(tokenizer_json, store)
    return _encoders[key]


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Content of a public tokenizer's file, for the driver to broadcast (a fixed size)."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")
