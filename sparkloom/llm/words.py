"""Words of whole texts in Arrow batches, cut by kinds of bytes, and binary columns of numbers.

Texts are cut in chunks of some MiB, so that a text of any length takes bounded memory: a chunk ends between
texts, or within a text at a byte that no word has.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
#: Kinds of bytes.
SPACE, WORD, BREAK = 0, 1, 2
#: A-Z become a-z, all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def kinds(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """The kind of each byte; what is neither space nor break is part of a word."""
    out = np.full(256, WORD, np.uint8)
    out[list(spaces)] = SPACE
    out[list(breaks)] = BREAK
    return out


@dataclass
class Words:
    """Words in order: their codes in vocabulary, the row that each is of, and the run of words between breaks."""

    vocabulary: pa.Array
    codes: np.ndarray
    rows: np.ndarray
    runs: np.ndarray
    size: int


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, and where each starts, with the end."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def _ends(flat: np.ndarray, offsets: np.ndarray, table: np.ndarray, size: int) -> Iterator[int]:
    """Where chunks end."""
    at, whole = 0, len(flat)
    # within a text only at a break, if there are breaks at all: a run of words must not be cut
    inner = BREAK if (table == BREAK).any() else SPACE
    while at < whole:
        end = min(at + size, whole)
        if end < whole:
            k = int(np.searchsorted(offsets, end, "right")) - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:
                text_end = int(offsets[k + 1])
                while end < text_end:
                    there = np.flatnonzero(table[flat[end : min(end + size, text_end)]] == inner)
                    if len(there):
                        end += int(there[0])
                        break
                    end = min(end + size, text_end)
        yield end
        at = end


def words(texts: pa.Array, table: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """The lower-case words of texts, chunk by chunk."""
    flat, offsets = _bytes(texts)
    at = 0
    for end in _ends(flat, offsets, table, size):
        part = flat[at:end]
        kind = table[part]
        real = kind == WORD
        start = real.copy()
        start[1:] &= ~real[:-1]
        inner = offsets[(offsets > at) & (offsets < end)] - at
        start[inner] = real[inner]
        places = np.flatnonzero(start)
        before = np.cumsum(real, dtype=np.int32)
        bounds = np.empty(len(places) + 1, np.int32)
        bounds[:-1] = before[places] - 1
        bounds[-1] = before[-1] if len(before) else 0
        kept = pa.py_buffer(LOWER[part[real]])
        coded = pa.StringArray.from_buffers(len(places), pa.py_buffer(bounds), kept).dictionary_encode()
        rows = np.searchsorted(offsets, places + at, "right") - 1
        runs = np.searchsorted(np.flatnonzero(kind == BREAK), places) + rows
        yield Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), rows, runs, end - at)
        at = end


def counts(texts: pa.Array, table: np.ndarray, size: int = CHUNK_BYTES) -> np.ndarray:
    """How many words each text has."""
    flat, offsets = _bytes(texts)
    out, at = np.zeros(len(texts), np.int64), 0
    for end in _ends(flat, offsets, table, size):
        real = table[flat[at:end]] == WORD
        start = real.copy()
        start[1:] &= ~real[:-1]
        inner = offsets[(offsets > at) & (offsets < end)] - at
        start[inner] = real[inner]
        rows = np.searchsorted(offsets, np.flatnonzero(start) + at, "right") - 1
        out += np.bincount(rows, minlength=len(texts))
        at = end
    return out


def release() -> None:
    """Gives memory that a worker no longer uses back to the system; the worker itself lives on beside later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, of a task's batches, that gives memory back when it is done."""

    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return tidy


def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values cut at bounds, one run of raw bytes a row."""
    offsets = pa.py_buffer((np.asarray(bounds) * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def packed(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed: their count, then their first bytes, their second ones and so on."""
    held = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(held, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of packed()."""
    held = pa.decompress(data[4:], 4 * int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def numbers(column: pa.Array | pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows' values of a binary column as one array, and where each row's start, with the end."""
    out, sizes = [], []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        at = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, 4 * chunk.offset) if len(chunk) else np.zeros(1, np.int32)
        if at[-1] > at[0]:
            out.append(np.frombuffer(chunk.buffers()[2], np.uint8)[at[0] : at[-1]])
        sizes.append(np.diff(at))
    flat = np.concatenate(out).view(dtype) if out else np.zeros(0, dtype)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int64)
    return flat, bounds // np.dtype(dtype).itemsize


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where the runs of rows with equal keys start, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)
