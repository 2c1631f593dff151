"""Vectors as exact integers: the rows that count, sums by group, and their SQL.

Shared by the operators that move codebook entries or centroids to floor(sum / count).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components that one numpy block holds.
BLOCK = 1 << 19


def usable(v: Column) -> Column:
    """True for a vector that is not null and holds no null, NaN or infinite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.coalesce(F.exists(v.cast("array<double>"), bad), F.lit(False))


def floors(v: Column, scale: int) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def integers(vectors: pa.Array, scale: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * x) as int64) of the usable vectors of `width` components, in blocks.

    Components so large that squared distances would leave 63 bits raise an ArithmeticError.
    """
    flat = vectors.values.to_numpy(zero_copy_only=False)
    at = np.asarray(vectors.offsets, np.int64)
    fit = np.flatnonzero((np.diff(at) == width) & np.array(vectors.is_valid(), bool))
    most = float(np.sqrt(2.0**60 / (4 * width)) / 2)
    for i in range(0, len(fit), max(1, BLOCK // width)):
        rows = fit[i : i + max(1, BLOCK // width)]
        x = flat[at[rows][:, None] + np.arange(width)].astype(np.float64)
        good = np.isfinite(x).all(1)
        rows, x = rows[good], np.floor(x[good] * float(scale))
        if len(x) and np.abs(x).max() > most:
            raise ArithmeticError("squared distances of these vectors do not fit in 63 bits")
        if len(rows):
            yield rows, x.astype(np.int64)


class Sums:
    """Counts and componentwise sums by group number, held by one task."""

    def __init__(self, groups: int, width: int):
        self.n = np.zeros(groups, np.int64)
        self.s = np.zeros((groups, width), np.int64)

    def add(self, group: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        if len(first):
            self.s[group[order[first]]] += np.add.reduceat(x[order], first, axis=0)
            self.n += np.bincount(group, minlength=len(self.n))

    def batch(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.n)
        return pa.record_batch([pa.array(some, pa.int64()), pa.array(self.n[some]), pa.array(list(self.s[some]), pa.list_(pa.int64()))], ["g", "n", "s"])


def moved(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], old: np.ndarray) -> np.ndarray:
    """old (groups, width) with each group that has rows replaced by its floor(sum / count).

    Every task gives one row for each of its groups; Spark adds them up exactly, and as many
    numbers as `old` has come back.
    """
    found = rows.mapInArrow(partial, "g long, n long, s array<long>")
    each = found.select("g", "n", F.posexplode("s").alias("i", "x"))
    whole = each.groupBy("g", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = old.copy()
    for r in whole.collect():
        out[r["g"], r["i"]] = int(r["x"]) // r["n"]
    return out


def rounds_sql(rounds: int) -> str:
    """CTEs a1, c1, ...: assignments of points(n, p, s) to c0(p, e, s) and moved entries; a<rounds + 1> is the last assignment (n, p, s, d, e)."""
    assign = """a{k} AS MATERIALIZED (SELECT n, p, any_value(s) AS s, min(struct_pack(d := d, e := e)) AS m FROM (
    SELECT n, x.p AS p, x.s AS s, e, CAST(list_sum(list_transform(range(1, len(x.s) + 1), lambda i: (x.s[i] - c.s[i]) * (x.s[i] - c.s[i]))) AS BIGINT) AS d
    FROM points x JOIN c{j} c ON c.p = x.p) GROUP BY n, p)"""
    move = """c{k} AS MATERIALIZED (SELECT c.p AS p, c.e AS e, coalesce(new.s, c.s) AS s FROM c{j} c LEFT JOIN (
    SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY i) AS s FROM (
      SELECT p, m.e AS e, i, CAST(sum(s[i]) AS HUGEINT) AS total, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) GROUP BY p, m.e, i)
    GROUP BY p, e) new ON new.p = c.p AND new.e = c.e)"""
    steps = [f.format(k=k, j=k - 1) for k in range(1, rounds + 1) for f in (assign, move)]
    return ",\n".join([*steps, assign.format(k=rounds + 1, j=rounds)])
