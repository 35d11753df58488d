"""Array views of Arrow text columns: chunks of bounded size, characters, words, shingles.

Tasks see texts as Arrow batches. A batch is cut into chunks of about ``CHUNK`` bytes (a
longer text is a chunk of its own), so that the arrays derived from it stay small however
long the batch is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text handled at once inside a task
CHUNK = 1 << 18

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C55  # odd, so invertible modulo 2^64
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Chunk(NamedTuple):
    """Some rows of a batch: ``data[offsets[i]:offsets[i+1]]`` is the text of row i (null: empty)."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[Chunk]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(n, max(end, at + 1))
            yield Chunk(batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= _MIX[0]
    h ^= h >> np.uint64(27)
    h *= _MIX[1]
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=4)
def powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.ones(1 << log2, np.uint64)
        done = 1
        while done < len(p):
            take = min(done, len(p) - done)
            p[done : done + take] = p[:take] * np.uint64(pow(base, done, 1 << 64))
            done += take
        out.append(p)
    return out[0], out[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (data[x] + 1) * base^x over i <= x < j."""
    up, _ = powers(max(20, int(len(data)).bit_length()))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the bytes stand."""
    _, down = powers(max(20, int(len(prefix) - 1).bit_length()))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: every ASCII byte but letters and digits
NOT_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: ASCII letters in lower case, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: byte spans, and ``first[i]:first[i+1]`` per row."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(chunk: Chunk, breaks: np.ndarray = _SPACE) -> Words:
    """``breaks``: for each byte value, whether it parts words (ASCII white space by default)."""
    n = len(chunk.data)
    inside = ~breaks[chunk.data]
    border = np.zeros(n + 1, bool)
    border[chunk.offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | border[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    return Words(start, end, np.searchsorted(start, chunk.offsets))


_FULL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: spans of more bytes are hashed one by one
LONG = 256


class Bytes8:
    """The eight bytes from any position of ``data`` as one little-endian number, zeros beyond the end."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
        padded[: len(data)] = data
        self.whole = padded.view("<u8")

    def at(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Those of the first ``size`` bytes (at most eight)."""
        block, shift = place >> 3, ((place & 7) << 3).astype(np.uint64)
        high = (self.whole[block + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return ((self.whole[block] >> shift) | high) & _FULL[np.minimum(size, 8)]


def hashed_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of data[start:end], eight bytes after the other through a mixer, so that no pattern of bytes cancels out.

    Different spans of one size up to eight bytes have different hashes.
    """
    size = end - start
    bytes8 = Bytes8(data)
    h = mix(size.astype(np.uint64) + np.uint64(seed << 32))
    live = np.arange(len(size))
    for j in range(0, LONG, 8):
        live = live[size[live] > j] if j else np.flatnonzero(size > 0)
        if not len(live):
            break
        h[live] = mix(h[live] ^ bytes8.at(start[live] + j, size[live] - j))
    for i in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        h[i] = int.from_bytes(digest.digest(), "little")
    return h


def word_hashes(chunk: Chunk, w: Words, lower: bool = True, seed: int = 0) -> np.ndarray:
    return hashed_spans(LOWER[chunk.data] if lower else chunk.data, w.start, w.end, seed)


_STEP = [np.uint64((0xD1342543DE82EF95 * (2 * k + 3)) & _M64 | 1) for k in range(64)]


def shingles(hashes: np.ndarray, first: np.ndarray, k: int, short_whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and the row of each; repeats stay.

    ``short_whole``: a row of 1 to k - 1 words gives one shingle of all its words.
    """
    n, count = len(hashes), np.diff(first)
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += hashes[j : n - k + 1 + j] * _STEP[j]
    else:
        h = np.zeros(0, np.uint64)
    per = np.maximum(count - k + 1, 0)
    row = np.repeat(np.arange(len(count)), per)
    inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    out = mix(h[first[:-1][row] + inner] if len(row) else np.zeros(0, np.uint64))
    if short_whole:
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = count[short] > j
                extra[has] += hashes[first[short[has]] + j] * _STEP[j]
            out = np.concatenate([out, mix(extra + count[short].astype(np.uint64))])
            row = np.concatenate([row, short])
    return out, row


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, ordered by row and then hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is no letter."""
    table = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def codepoints(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the chunk and the offsets of its rows in them."""
    try:
        chars = np.frombuffer(chunk.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(chunk.data) + 1, np.int64)
        np.cumsum((chunk.data & 0xC0) != 0x80, out=heads[1:])
        return chars, heads[chunk.offsets]
    except UnicodeDecodeError:
        rows = [np.frombuffer(chunk.text(i).decode(errors="replace").encode("utf-32-le"), np.uint32) for i in range(len(chunk.offsets) - 1)]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]], zero for empty rows; each row is summed on its own."""
    out = np.add.reduceat(np.append(values, 0.0), offsets[:-1])
    out[offsets[1:] == offsets[:-1]] = 0.0
    return out


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the number of them in each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
