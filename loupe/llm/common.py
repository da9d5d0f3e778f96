"""Helpers shared by the training-data operators.

* ``keep`` cuts lineage through a Parquet table in the shared folder that
  ``spark.checkpoint.dir`` names; what a program has kept goes when it ends.
* ``grouped`` deals rows into groups of bounded bytes by a hash of the row, so
  a task holds one group and no key of the data can make a group large.
* ``string_buffers`` and the hash functions view an Arrow text column as one
  byte array, for numpy code over whole texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.session import keep, prepare, scratch  # noqa: F401 - used as C.keep, C.prepare, C.scratch

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def total_bytes(df: DataFrame, text: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def grouped(df: DataFrame, n_groups: int, *by: str) -> DataFrame:
    """Add ``g`` in [0, n_groups), a hash of the columns ``by``."""
    return df.withColumn("g", F.pmod(F.xxhash64(*by), F.lit(n_groups)).cast("int"))


def n_parts(amount: float, each: float) -> int:
    return max(1, math.ceil(amount / each))


def string_buffers(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column, null as empty; rows i is bytes[offsets[i]:offsets[i+1]]."""
    arr = pc.fill_null(col.cast(pa.large_binary()), b"")
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    if len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection on 64-bit integers)."""
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, q: int, seed: int = 1) -> np.ndarray:
    """Hash of the q bytes from each position on, by doubling the length hashed."""
    x = data.astype(np.uint64)
    if len(x) < q:
        return np.empty(0, np.uint64)
    n, done, size = len(x) - q + 1, 0, 1
    power, out = mix(x + np.uint64(seed * 1000003)), None
    while q:
        if q & 1:
            part = power[done:done + n]
            out = part if out is None else mix(out * M1 + part)
            done += size
        q >>= 1
        if q:
            power = mix(power[:-size] * M1 + power[size:])
            size *= 2
    return out


# words are maximal runs of ASCII letters, digits and all non-ASCII characters; ASCII upper case is folded
WORD_SQL = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
_P = 0x9E3779B97F4A7C55
_CHUNK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_P, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    return np.cumprod(np.append(one, np.full(n, _P, np.uint64))), np.cumprod(np.append(one, np.full(n, inv, np.uint64)))


_POW: tuple[np.ndarray, np.ndarray] | None = None


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the row of each word."""
    global _POW
    if _POW is None:
        _POW = _powers(_CHUNK)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    low = _FOLD[data]
    word = _IS_WORD[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs[(offs >= 0) & (offs <= len(data))]] = True  # a word never crosses rows
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(s), np.uint64)
    a = 0
    while a < len(s):  # in chunks that start and end between words
        b = max(a + 1, int(np.searchsorted(e, s[a] + _CHUNK, "right")))
        base, top = s[a], e[b - 1]
        if top - base > _CHUNK:  # one word longer than a chunk
            out[a] = np.uint64(int.from_bytes(low[base:top].tobytes(), "little") % ((1 << 64) - 59))
            a += 1
            continue
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum((low[base:top].astype(np.uint64) + np.uint64(1)) * _POW[0][:top - base], out=sums[1:])
        i, j = s[a:b] - base, e[a:b] - base
        out[a:b] = (sums[j] - sums[i]) * _POW[1][i] + (j - i).astype(np.uint64)
        a = b
    return mix(out), np.searchsorted(offs, s, "right") - 1


def planes(x: np.ndarray, n_bytes: int) -> bytes:
    """The low ``n_bytes`` bytes of unsigned numbers: all lowest bytes, then all second ones, and so on.

    Bytes that are mostly zero lie together, so the codec of the shuffle removes them.
    """
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T.tobytes()


def from_planes(blob: bytes, n_bytes: int) -> np.ndarray:
    out = np.zeros((len(blob) // n_bytes, 8), np.uint8)
    out[:, :n_bytes] = np.frombuffer(blob, np.uint8).reshape(n_bytes, -1).T
    return out.reshape(-1).view("<u8")


def numbers(x: np.ndarray) -> bytes:
    """Counts in the fewest of 1, 2, 4 or 8 bytes each."""
    top = int(x.max()) if len(x) else 0
    return planes(x, next(n for n in (1, 2, 4, 8) if top < 1 << 8 * n))


def from_numbers(blob: bytes, n: int) -> np.ndarray:
    return from_planes(blob, max(1, len(blob) // max(n, 1))).astype(np.int64)


def pack(keys: np.ndarray, n_bytes: int) -> bytes:
    """Ascending keys below ``2**(8 * n_bytes)`` as the gaps between them."""
    return planes(np.diff(keys, prepend=np.uint64(0)), n_bytes)


def unpack(blob: bytes, n_bytes: int) -> np.ndarray:
    return np.cumsum(from_planes(blob, n_bytes), dtype=np.uint64)


def asks(keys48: np.ndarray, n_ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the slices of sorted 48-bit keys, without empty ones."""
    r = (keys48 >> np.uint64(16)) * np.uint64(n_ranges) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.empty(0, int)
    ends = np.append(at[1:], len(r))
    return [(int(r[i]), int(i), int(j)) for i, j in zip(at, ends)]
