"""Vector code compression: product codes whose nearest entries are found by Orchard search.

Vectors become integers, floor(4096 * x), and are cut into equal parts; each part position has
a codebook. The nearest entry of a part is found by walking the distance-sorted neighbour list
of the best entry so far: a neighbour that is nearer takes over and its own list is walked from
the start, entries once compared are marked and skipped, and a walk ends where the list is
further away than twice the current distance (the triangle inequality leaves nothing nearer
behind it). All parts of a block walk side by side in numpy, each with its own list and place.

Codebooks are made in rounds over all rows: each task adds up the parts of each entry, Spark
adds the tasks' sums, and only the codebooks themselves reach the driver. They go to the tasks
in the function that encodes; their size is entries * components, whatever the rows are.

Defined results: rows whose vector is null, empty or holds a null, NaN or infinite component
are left out, as are vectors of another length than the most frequent one that `parts` divides
(of equally frequent lengths the greatest). Null ids come after all others, rows of one id in
the order of their vectors; every row gets a code, repeated rows each. With fewer rows than
entries, codebooks are as small as the rows are few. Ties go to the lower entry. Without usable rows there is
no row. Components beyond exact 64-bit distances raise an ArithmeticError. Other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burin.llm.common import persisted
from burin.llm.integer_vectors import Sums, floors, integers, moved, rounds_sql, usable

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Shares into which the rows of one label are dealt when its total goes back to them.
SALTS = 16


class Orchard:
    """Nearest entry search of one codebook of integer entries (k, width)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        d = ((entries[:, None] - entries[None]) ** 2).sum(2)
        # An entry's own place is at the front of its list; it is left out by its index, as equal entries are at distance 0 too.
        k = len(entries)
        order = np.argsort(np.where(np.eye(k, dtype=bool), -1, d), axis=1, kind="stable")[:, 1:]
        self.near, self.dist = order, np.take_along_axis(d, order, 1)
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of x; ties to the lower entry."""
        n, k = len(x), len(self.entries)
        at = np.zeros(n, np.int64)
        best = ((x - self.entries[0]) ** 2).sum(1)
        self.compared += n
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        place = np.zeros(n, np.int64)
        walking = np.arange(n)
        while len(walking) and k > 1:
            # The rest of a list cannot hold an entry as near once its head is beyond twice the distance.
            p = place[walking]
            on = p < k - 1
            on[on] = self.dist[at[walking[on]], p[on]] <= 4 * best[walking[on]]
            walking = walking[on]
            e = self.near[at[walking], place[walking]]
            place[walking] += 1
            fresh = ~seen[walking, e]
            rows, e = walking[fresh], e[fresh]
            seen[rows, e] = True
            d = ((x[rows] - self.entries[e]) ** 2).sum(1)
            self.compared += len(rows)
            nearer = (d < best[rows]) | ((d == best[rows]) & (e < at[rows]))
            rows, e, d = rows[nearer], e[nearer], d[nearer]
            at[rows], best[rows], place[rows] = e, d, 0
        return at, best


@dataclass
class Codebooks:
    """entries (parts, k, width of a part) of integers floor(scale * x)."""

    entries: np.ndarray
    scale: int

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes (n, parts) stand for, as floats at the middle of each integer's step."""
        parts = self.entries[np.arange(len(self.entries)), codes]
        return (parts.reshape(len(codes), self.width) + 0.5) / self.scale


def _codes(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, rows, parts (n, parts, width), codes (n, parts), squared distances) of the last column's vectors, in blocks."""
    finders = [Orchard(e) for e in books.entries]
    for batch in batches:
        for rows, x in integers(batch.column(batch.num_columns - 1), books.scale, books.width):
            x = x.reshape(len(x), len(finders), -1)
            found = [f.nearest(np.ascontiguousarray(x[:, p])) for p, f in enumerate(finders)]
            yield batch, rows, x, np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1)


def width_of(rows: DataFrame, vector: str, parts: int) -> int:
    """The most frequent length of usable vectors that `parts` divides, 0 without one."""
    length = F.size(vector)
    found = rows.where(usable(F.col(vector)) & (length > 0) & (length % parts == 0)).groupBy(length.alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    return found[0]["width"] if found else 0


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after `rounds` rounds over all rows, from the rows of the smallest ids; None without usable rows."""
    width = width_of(rows, vector, parts)
    if not width:
        return None
    held = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    first = held.where(usable(F.col("v")) & (F.size("v") == width)).orderBy(F.asc_nulls_last("k"), "v").limit(entries).select(floors(F.col("v"), scale).alias("v")).collect()
    start = np.array([r["v"] for r in first], np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        k, each = books.entries.shape[1:]
        books = Codebooks(moved(held.select("v"), _summing(books), books.entries.reshape(parts * k, each)).reshape(books.entries.shape), scale)
    return books


def _summing(books: Codebooks):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = books.entries.shape
        sums = Sums(parts * k, width)
        for _, _, x, codes, _ in _codes(batches, books):
            sums.add((codes + np.arange(parts) * k).ravel(), x.reshape(-1, width))
        yield sums.batch()

    return apply


def encode(rows: DataFrame, books: Codebooks, *keep: str, vector: str = "embedding") -> DataFrame:
    """The kept columns, codes (an index for each part) and error (squared distance to the decoded integers) of each usable row."""
    if {"codes", "error"} & set(keep):
        raise ValueError("a kept column may not be named codes or error")
    kept = rows.select(*keep)
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "codes array<int>", "error long"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, _, codes, d in _codes(batches, books):
            own = [batch.column(i).take(pa.array(at)) for i in range(len(keep))]
            yield pa.record_batch([*own, pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(d.sum(1))], [*keep, "codes", "error"])

    return rows.select(*keep, F.col(vector).alias("__vector")).mapInArrow(apply, ", ".join(fields))


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **settings: int) -> DataFrame:
    """key, code (two hex digits a part), error, label_error (sum over equal labels, nulls together), codebooks_sha256."""
    slim = rows.select(F.col(key).alias("__key"), F.col(label).alias("__label"), F.col(vector).alias("__v"))
    books = fit(slim, "__key", "__v", **settings)
    names = (F.col("__key").alias(key), "code", "error", "label_error")
    if books is None:
        none = slim.where("false").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long"), "label_error": F.lit(0).cast("long")})
        return none.select(*names, F.lit("").alias("codebooks_sha256"))
    hexed = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    coded = persisted(encode(slim, books, "__key", "__label", vector="__v").select("__key", "__label", hexed.alias("code"), "error"))
    # A label may hold a third of the rows: its total, one row, is given to SALTS shares of them.
    totals = coded.groupBy("__label").agg(F.sum("error").alias("label_error")).select(F.col("__label").alias("__of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__share"))
    dealt = coded.withColumn("__salt", F.pmod(F.xxhash64("__key", "code"), F.lit(SALTS)).cast("int"))
    met = dealt.join(totals, dealt["__label"].eqNullSafe(totals["__of"]) & (dealt["__salt"] == totals["__share"]))
    return met.select(*names, F.lit(books.digest()).alias("codebooks_sha256"))


SQL = f"""
WITH usable AS (
  SELECT vec_id, label, embedding AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS n, vec_id, label,
         list_transform(x, lambda y: CAST(floor({SCALE} * CAST(y AS DOUBLE)) AS BIGINT)) AS v
  FROM usable WHERE len(x) = (SELECT len(x) FROM usable GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
points AS MATERIALIZED (
  SELECT n, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS s FROM kept, LATERAL (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, n - 1 AS e, s FROM points WHERE n <= {ENTRIES}),
{rounds_sql(ROUNDS)},
coded AS (
  SELECT n, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM a{ROUNDS + 1} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (n)
"""
