"""Token ids of whole texts, through the tokenizers library.

The vocabulary of ``word_bpe_49k.json`` drops white space and never merges across it, so a text's ids are
the ids of its white-space separated words in turn. Words repeat, therefore each distinct word of a batch is
looked up once, all in one search of arrays, and only words that a worker doesn't remember go through the library.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries and ids a worker remembers; beyond that it keeps those in use. Bounds memory, not results.
CACHE_WORDS = 600_000
CACHE_IDS = 4_000_000
#: Bytes of a word that its key has room for; the few longer words are remembered by name.
KEY_BYTES = 15
#: Bytes of text that one step works on.
STEP_BYTES = 2 << 20

#: Latin-1 letters (beside ASCII) that are their own normal form.
_UPPER, _LOWER = "\u00c0-\u00d6\u00d8-\u00de", "\u00df-\u00f6\u00f8-\u00ff"
#: A text with anything beyond ASCII and these letters, or the start of a special token, is odd: its words go
#: through the library's whole chain. In all others case folding and PIECES split just as the vocabulary's
#: pattern does, and only the library's model is asked.
ODD = f"[^\\x09-\\x0d\\x20-\\x7e{_UPPER}{_LOWER}]|<\\|"
PIECES = f"('s|'t|'re|'ve|'m|'ll|'d|[a-z{_LOWER}]+|[0-9]|[^a-z0-9{_LOWER}\\x09-\\x0d\\x20]+)"

#: Kinds of bytes in lower-case text that isn't odd: white space, letters, digits, others.
DIGIT = 2
KINDS = np.full(256, 3, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 0
KINDS[np.r_[97:123, 128:256]] = 1
KINDS[48:58] = DIGIT

#: The first bytes of eight, by their number.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

_encoders: dict[str, "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str | None = None) -> "WordEncoder":
    """The worker's encoder of a vocabulary file; None: the default one of this machine."""
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self._reset()

    def _reset(self) -> None:
        # by slot; slot 0 is the empty word, which has no ids
        self.low, self.high = np.zeros((2, 1 << 14), np.uint64)
        self.starts, self.sizes, self.uses = np.zeros((3, 1 << 14), np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.n_words, self.n_ids = 1, 0
        # slots by ascending hash, and those of long words by name
        self.hashes, self.by_hash = np.zeros(1, np.uint64), np.zeros(1, np.int32)
        self.long: dict[str, int] = {}

    def _piece(self, piece: str) -> list[int]:
        if piece[:1] == "\0":  # a whole word of an odd text
            return self.tokenizer.encode(piece[1:], add_special_tokens=False).ids
        if not piece.strip(" \t\n\v\f\r"):
            return []
        mapped = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        return [t.id for t in self.model.tokenize(mapped)]

    def _find(self, names: pa.Array, low: np.ndarray, high: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The slots of names, -1 where a name isn't remembered."""
        at = np.searchsorted(self.hashes, hashed(low, high))
        slots = self.by_hash[np.minimum(at, len(self.by_hash) - 1)]
        # the hash only says where to look; keys of short names are equal only if the names are
        slots[(self.low[slots] != low) | (self.high[slots] != high)] = -1
        long = np.flatnonzero(lengths > KEY_BYTES)
        if len(long):
            slots[long] = [self.long.get(w, -1) for w in names.take(pa.array(long)).to_pylist()]
        return slots

    def _learn(self, pieces: list[str], low: np.ndarray, high: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The slots that new pieces get."""
        ids = [self._piece(w) for w in pieces]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        total, slots = int(sizes.sum()), np.arange(self.n_words, self.n_words + len(ids), dtype=np.int32)
        self.flat = _room(self.flat, self.n_ids + total)
        for name in ("low", "high", "starts", "sizes", "uses"):
            setattr(self, name, _room(getattr(self, name), self.n_words + len(ids)))
        self.low[slots], self.high[slots], self.sizes[slots], self.uses[slots] = low, high, sizes, 0
        self.starts[slots] = self.n_ids + np.cumsum(sizes) - sizes
        self.flat[self.n_ids : self.n_ids + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self._enter(slots[lengths <= KEY_BYTES])
        self.long.update((pieces[i], int(slots[i])) for i in np.flatnonzero(lengths > KEY_BYTES).tolist())
        self.n_words += len(ids)
        self.n_ids += total
        return slots

    def _enter(self, slots: np.ndarray) -> None:
        """Makes the slots of short words findable."""
        hashes = hashed(self.low[slots], self.high[slots])
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.by_hash = np.insert(self.hashes, at, hashes[order]), np.insert(self.by_hash, at, slots[order])

    def _forget(self) -> None:
        """Keeps the words that more than one step has used since this was last done, the most used ones first and
        half of what is allowed at most."""
        held = self.low, self.high, self.starts, self.sizes, self.flat, self.long
        kept = np.flatnonzero(self.uses[1 : self.n_words] > 1) + 1
        kept = kept[np.argsort(-self.uses[kept], kind="stable")][: CACHE_WORDS // 2]
        kept = kept[np.cumsum(self.sizes[kept]) <= CACHE_IDS // 2]
        self._reset()
        low, high, starts, sizes, flat, long = held
        n, total = len(kept) + 1, int(sizes[kept].sum())
        slots = np.full(len(sizes), -1, np.int32)
        slots[kept] = np.arange(1, n)
        for name, values in (("low", low), ("high", high), ("sizes", sizes)):
            setattr(self, name, _room(getattr(self, name), n))
            getattr(self, name)[1:n] = values[kept]
        self.starts, self.uses = _room(self.starts, n), _room(self.uses, n)
        self.starts[1:n] = np.cumsum(sizes[kept]) - sizes[kept]
        self.flat = _room(self.flat, total)
        self.flat[:total] = flat[np.repeat(starts[kept] - self.starts[1:n], sizes[kept]) + np.arange(total)]
        self.n_words, self.n_ids = n, total
        self.long = {w: int(slots[i]) for w, i in long.items() if slots[i] > 0}
        short = np.ones(n, bool)
        short[[0, *self.long.values()]] = False
        self._enter(np.flatnonzero(short).astype(np.int32))

    def _ids(self, pieces: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, and their number for each text; offsets: each text's first piece."""
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int32)
        coded = pieces.dictionary_encode()
        names = coded.dictionary
        if self.n_words > CACHE_WORDS or self.n_ids > CACHE_IDS:
            self._forget()
        low, high, lengths = keys(names)
        slots = self._find(names, low, high, lengths)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            slots[missing] = self._learn(names.take(pa.array(missing)).to_pylist(), low[missing], high[missing], lengths[missing])
        self.uses[slots] += 1
        sizes, starts = self.sizes[slots], self.starts[slots]
        at = coded.indices.to_numpy()
        sizes, starts = sizes[at], starts[at]
        ends = np.cumsum(sizes, dtype=np.int32)
        total = int(ends[-1])
        starts -= ends
        starts += sizes
        where = np.repeat(starts, sizes)
        where += np.arange(total, dtype=np.int32)
        return self.flat[where], np.diff(np.concatenate([[0], ends])[offsets])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none), and the number of ids of each text."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        odd = pc.match_substring_regex(texts, ODD)
        contracted = pc.and_not(pc.match_substring_regex(texts, "'[a-zA-Z]"), odd)
        ids, sizes = self._ids(*runs(pc.utf8_lower(pc.if_else(pc.or_(odd, contracted), "", texts))))
        for some, pattern, mark in ((contracted, PIECES, "\\1 "), (odd, "([^\\x09-\\x0d\\x20]+)", "\0\\1")):
            where = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            if len(where):
                held = texts.take(pa.array(where))
                split = pc.ascii_split_whitespace(pc.replace_substring_regex(held if some is odd else pc.utf8_lower(held), pattern, mark))
                offsets = split.offsets.to_numpy()
                more, more_sizes = self._ids(split.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0])
                ids, sizes = _merged(ids, sizes, where, more, more_sizes)
        return ids, sizes


def keys(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two numbers for each name and its length in bytes: the first KEY_BYTES bytes, then the length in a byte. No
    two names of up to KEY_BYTES bytes have the same."""
    offsets = np.frombuffer(names.buffers()[1], np.int32, len(names) + 1, 4 * names.offset)
    data = names.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    eights = np.ndarray(len(raw) + 9, "<u8", np.concatenate([raw, np.zeros(16, np.uint8)]), strides=(1,))
    at, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    low = eights[at] & MASKS[np.minimum(lengths, 8)]
    high = eights[at + 8] & MASKS[np.clip(lengths - 8, 0, KEY_BYTES - 8)]
    return low, high | lengths.astype(np.uint64) << np.uint64(56), lengths


def hashed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low ^ high * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """The array, with zeros added so that it has n entries at least."""
    return held if n <= len(held) else np.concatenate([held, np.zeros(max(len(held), n - len(held)), held.dtype)])


def runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut into runs of letters, of white space and of other characters, and single digits; the number of
    each text's first run. For lower-case text that isn't odd and has no contractions."""
    held = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    buffer = texts.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8)[held[0] : held[-1]] if buffer is not None else np.zeros(0, np.uint8)
    bounds = held - held[0]
    kind = KINDS[raw]
    first = np.empty(len(raw) + 1, bool)
    first[1:-1] = kind[1:] != kind[:-1]
    first[:-1] |= kind == DIGIT
    first[bounds] = True
    starts = np.flatnonzero(first).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(raw)])
    return pieces, np.searchsorted(starts, bounds)


def _merged(ids: np.ndarray, sizes: np.ndarray, where: np.ndarray, more: np.ndarray, more_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids and sizes with those of the texts at where, which had none so far, put in."""
    sizes = sizes.copy()
    sizes[where] = more_sizes
    is_more = np.zeros(len(sizes), bool)
    is_more[where] = True
    mask = np.repeat(is_more, sizes)
    out = np.empty(len(mask), np.uint32)
    out[mask], out[~mask] = more, ids
    return out, sizes


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES):
    """Slices of a batch with about limit bytes of the column each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    done, start = 0, 0
    ends = np.cumsum(sizes)
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text's."""
    if end_id is None:
        return ids, sizes
    return np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1


def as_binary(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array with the little-endian 32-bit ids of each text."""
    offsets = np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def from_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes of a binary array without nulls."""
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]].view("<u4"), np.diff(offsets.astype(np.int64)) // 4


def crc32s(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The unsigned crc32 of each text's ids as little-endian 32-bit integers."""
    held, ends = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), np.cumsum(sizes) * 4
    return pa.array([zlib.crc32(held[s:e]) for s, e in zip((ends - sizes * 4).tolist(), ends.tolist())], pa.int64())
