"""Shared pieces of the training-data operators.

Texts travel as Arrow buffers: operators look at the UTF-8 bytes of a whole
batch as one numpy array and cut it into blocks of bounded size, so a worker's
memory follows the block and the longest single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burin.storage import persisted, scratch, shared_dir  # noqa: F401

#: Bytes of text that one numpy block holds (a longer text is a block alone).
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    own = {c.lower() for c in taken}
    while name.lower() in own:
        name = "_" + name
    return name


def crc_bucket(key: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text modulo mod; null ids give null."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % mod


def held_out(key: str, mod: int, rest: int) -> Column:
    """True for the held-out fold; a null id is never learned from, so True."""
    return F.coalesce(crc_bucket(key, mod) == rest, F.lit(True))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most `most` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: ASCII upper case folded to lower case, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after folding: digits, a-z, all of non-ASCII.
WORD = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_MIX ** (0 .. n - 1) modulo 2 ** 64."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << int(n - 1).bit_length()
        out = np.empty(size, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.full(size - 1, _MIX), out=out[1:])
        _POWERS = out
    return _POWERS[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray = WORD, fold: bool = True):
    """Words of a block of texts.

    Returns (starts, ends, hash, row): byte bounds in data, a 64-bit hash of the
    folded bytes, and the text each word stands in. A word never spans two texts.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    low = FOLD[data] if fold else data
    inside = members[low]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    edge[cuts] = inside[cuts]
    starts = np.flatnonzero(edge)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    where = np.flatnonzero(inside)
    first = np.searchsorted(where, starts) if len(where) != len(data) else starts
    lengths = np.diff(np.append(first, len(where)))
    within = np.arange(len(where)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        value = (low[where].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[within]
        hashed = scramble(np.add.reduceat(value, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    row = np.searchsorted(offsets, starts, side="right") - 1
    return starts, starts + lengths, hashed, row


def per_row(offsets_of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by row number."""
    return np.bincount(offsets_of, weights=values, minlength=n)


def sampled(df: DataFrame, bound: int, salt: int, *keys: str) -> DataFrame:
    """About min(bound, rows) rows, chosen by a hash of keys, never over bound.

    Used only to fit models; the hash makes the choice repeatable.
    """
    n = df.count()
    if n <= bound:
        return df
    share = 0.97 * bound / n
    return df.where(F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(1 << 30)) < int(share * (1 << 30))).limit(bound)
