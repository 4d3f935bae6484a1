"""Vectorised word tokenising of Arrow text columns.

A token is a maximal run of letters and digits, lower-cased. A column is split
on white space and dictionary-encoded; only the distinct raw words of a batch
that aren't plain are split further. All of it is native code: no word becomes
a Python object. Null text has no tokens.
"""

from __future__ import annotations

import ctypes
import inspect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: ASCII in lower case, with a space for what is neither letter nor digit; other bytes as they are.
ASCII = np.array([*(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)), *range(128, 256)], np.uint8)
#: Bytes of text that are worked on at once; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def bounded(batches, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where a column's values reach a number of bytes; rows stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        for a, b in slices(ends, limit):
            yield batch.slice(a, b - a)
            release()


def release() -> None:
    """Gives memory that is free, of Arrow and of numpy, back to the system: a worker keeps its process."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the C library, where it has it
        trim(0)


def released(run):
    """A function over the table or the batches of a group that leaves no free memory behind."""
    if inspect.isgeneratorfunction(run):

        def lean(*args):
            yield from run(*args)
            release()
    else:

        def lean(*args):
            out = run(*args)
            release()
            return out

    lean.__signature__ = inspect.signature(run)
    lean.__annotations__ = run.__annotations__
    return lean


def plain(column) -> pa.Array:
    """One string array of a column that may be chunked, null or large."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def _split(raw: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens, number of tokens of each) of distinct lower-case raw words."""
    odd = pc.invert(pc.fill_null(pc.utf8_is_alnum(raw), False))
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    counts = np.ones(len(raw), np.int64)
    if not len(at):
        return raw, counts
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_substring_regex(raw.take(pa.array(at)), r"[^\p{L}\p{N}]+", " ")))
    flat = parts.flatten()
    some = pc.not_equal(flat, "")
    offsets = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    flat = flat.filter(some)
    counts[at] = np.diff(offsets)
    # plain words first, then the parts of the others; ``take`` puts them in order
    ends = np.concatenate(([0], np.cumsum(counts)))
    place = np.empty(int(ends[-1]), np.int64)
    even = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
    place[ends[even]] = np.arange(len(even))
    place[np.repeat(ends[at] - offsets[:-1], np.diff(offsets)) + np.arange(len(flat))] = len(even) + np.arange(len(flat))
    return pa.concat_arrays([raw.take(pa.array(even)), flat]).take(pa.array(place)), counts


def encode(column, known: pa.Array | None = None):
    """(ids int32, offsets int64, words) of all tokens of a column, in order.

    Without ``known``, ids index ``words``. With it, ids are the places in ``known``
    and -1 elsewhere, and ``words`` is empty.
    """
    column = plain(column)
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = ASCII[np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]]
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offs - offs[0]), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(text)
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    at = at - at[0]
    raw = flat.indices.to_numpy(zero_copy_only=False)
    words, counts = _split(pc.utf8_lower(flat.dictionary))
    if known is None:
        coded = words.dictionary_encode()
        ids, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    else:
        ids, words = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False), words[:0]
    ids = ids.astype(np.int32, copy=False)
    if len(counts) and counts.min() == counts.max() == 1:
        return ids[raw], at, words
    starts = np.concatenate(([0], np.cumsum(counts)))
    per = counts[raw]
    ends = np.concatenate(([0], np.cumsum(per)))
    take = np.repeat(starts[raw] - ends[:-1], per)
    take += np.arange(int(ends[-1]))
    return ids[take], ends[at], words


def hashes(words) -> np.ndarray:
    """64-bit hashes of words: 8 bytes at a time, all words at once; by xxhash those of more than 64 bytes."""
    words = pa.array(words, pa.large_string()) if isinstance(words, list) else words.cast(pa.large_string())
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    size, first = np.diff(offs), (offs[:-1] - offs[0])
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    wide = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    out = mixed(size.astype(np.uint64) + MIX)
    rows, k = np.flatnonzero(size <= 64), 0
    rows = rows[size[rows] > 0]
    while len(rows):
        left = np.minimum(size[rows] - 8 * k, 8).astype(np.uint64)
        chunk = wide[first[rows] + 8 * k] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        out[rows] = mixed(out[rows] * MIX + chunk)
        k += 1
        rows = rows[size[rows] > 8 * k]
    for i in np.flatnonzero(size > 64):
        out[i] = xxhash.xxh3_64_intdigest(data[first[i] : first[i] + size[i]].tobytes())
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grams(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` token hashes; windows may cross documents."""
    count = len(hashed) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out *= MIX
        out += hashed[k : k + count]
    return mixed(out)


def slices(offsets: np.ndarray, tokens: int) -> list[tuple[int, int]]:
    """Runs of whole documents of about so many tokens each."""
    out, at, last = [], 0, len(offsets) - 1
    while at < last:
        to = int(np.searchsorted(offsets, offsets[at] + tokens, "right")) - 1
        to = min(last, max(at + 1, to))
        out.append((at, to))
        at = to
    return out
