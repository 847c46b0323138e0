"""Vectorised tokenising of Arrow text columns: whole texts as flat UTF-8 bytes.

All functions see a run of rows at once as (data, offsets): the bytes of the
texts end to end and the n + 1 offsets of the rows.  Null texts are empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a run of its own.
RUN_BYTES = 4 << 20

IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of the words [^\x20\x09-\x0D]+.
SOLID = np.ones(256, dtype=bool)
SOLID[0x20] = SOLID[0x09:0x0E] = False


def runs(batch: pa.RecordBatch, column: str = "text", limit: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch of about `limit` text bytes, each with its data and offsets."""
    texts = batch.column(batch.schema.get_field_index(column))
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    release()


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Gives freed memory back to the system: workers are reused, and so would be the peak of each task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def words(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the offsets of each row's words among them."""
    inside = solid[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_SALT = np.random.default_rng(7).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, the same in every process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    power = np.full(int(lens.max()), _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    h = np.add.reduceat(_SALT[data[place + np.repeat(starts, lens)]] * power[place], first)
    h ^= lens.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + counts[i] - 1 of all i, end to end."""
    if not len(counts):
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - first, counts)


#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _xxh64_of(length: int, at, u64, u32, u8, seed: int) -> np.ndarray:
    """XXH64 of the spans of one length that begin at `at`."""
    s, done = np.uint64(seed), 0
    with np.errstate(over="ignore"):
        if length >= 32:
            zero = np.zeros(len(at), np.uint64)
            acc = [zero + (s + P1 + P2), zero + (s + P2), zero + s, zero + (s - P1)]
            while done + 32 <= length:
                acc = [_round(a, u64[at + (done + 8 * i)]) for i, a in enumerate(acc)]
                done += 32
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                h = (h ^ _round(np.uint64(0), a)) * P1 + P4
        else:
            h = np.full(len(at), s + P5)
        h = h + np.uint64(length)
        while done + 8 <= length:
            h = _rotl(h ^ _round(np.uint64(0), u64[at + done]), 27) * P1 + P4
            done += 8
        if done + 4 <= length:
            h = _rotl(h ^ (u32[at + done].astype(np.uint64) * P1), 23) * P2 + P3
            done += 4
        while done < length:
            h = _rotl(h ^ (u8[at + done].astype(np.uint64) * P5), 11) * P1
            done += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of the spans, in numpy: those of one length together."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    n = len(padded)
    u64 = np.ndarray((n - 7,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((n - 3,), "<u4", padded, strides=(1,))
    lens = ends - starts
    order = np.argsort(lens, kind="stable")
    out = np.empty(len(starts), np.uint64)
    cuts = np.flatnonzero(np.diff(lens[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        which = order[a:b]
        out[which] = _xxh64_of(int(lens[which[0]]), starts[which], u64, u32, padded, seed)
    return out
