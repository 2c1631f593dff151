"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its five-word shingles. Documents with equal sets are one
representative with a number of copies. Representatives that agree on a whole band of
their MinHash signature are candidates, bands over all documents by a distributed
aggregation; bands with the same members are looked at once. With BANDS bands of BAND_ROWS
values a pair at the threshold misses all bands with probability (1 - 0.8 ** 4) ** 32 =
5e-8, and less above it.

Pairs of candidates are compared by their MinHash values (the low byte of each, which can
only add matches), CHUNK at a time; a pair is dropped as soon as the posterior probability
that its similarity reaches the threshold (uniform prior, binomial matches) is under
TOLERANCE. The pairs left over, each band giving a spanning forest of them, make components:
so documents that only share a band, or a passage, are not drawn together. Within such a
component pairs are compared again by whole MinHash values in the same way, and what is left
is verified exactly on the shingles, by products of incidence matrices.

A band or component of many representatives is cut into blocks by a hash and each pair of
blocks is one group of rows, so no group grows with it; a block pair gives each
representative at most one row, never the pairs.

Result: one row for each document with its representative, its number of links (other
documents at or above the threshold, copies among them) and its class, the component of
links, named by its smallest document id.

Defined results: words are runs of digits, a-z after folding A-Z, and non-ASCII; a text
of one to four words has one shingle, all its words; null, empty and wordless texts are
linked to nothing. Rows with a null id have null class and no links; rows that repeat
an id count as one document if their texts are equal, otherwise the id stands for the
row with the smallest set hash. Similarity is exactly the threshold or more.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burin.llm.common import blocks, free_name, persisted, powers, scramble, text_buffers, words
from burin.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 32, 4
VALUES = BANDS * BAND_ROWS
CHUNK, TOLERANCE = 16, 1e-7
#: Representatives of a block, and bytes of shingles of a block.
BLOCK_ROWS, BLOCK_SHINGLE_BYTES = 768, 16 << 20
#: Representatives of a block of a band, which have their low bytes of MinHash values alone.
BAND_BLOCK_ROWS = 2048
#: Members of components that are sent to workers as a table (16 bytes each); more are joined by a shuffle.
SENT_MEMBERS = 500_000

_MULTIPLY = (scramble(np.arange(1, VALUES + 1).astype(np.uint64)) | np.uint64(1)).astype(np.uint32)
_ADD = scramble(np.arange(1001, VALUES + 1001).astype(np.uint64)).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, n + 1 offsets)."""
    n = len(offsets) - 1
    _, _, key, row = words(data, offsets)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    width = np.minimum(count, SHINGLE)
    made = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(n), made)
    at = np.repeat(first, made) + np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    step = powers(SHINGLE + 1)
    value = np.zeros(len(owner), np.uint64)
    padded = np.append(key, np.zeros(SHINGLE, np.uint64))
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            value += np.where(k < width[owner], padded[at + k] * step[k], np.uint64(k + 1))
    value = scramble(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
        value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n + 1))


def signatures(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(n, VALUES) MinHash values of sets; sets must not be empty."""
    low = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, VALUES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(VALUES):
            mixed = (low ^ _ADD[k]) * _MULTIPLY[k]
            out[:, k] = np.minimum.reduceat(mixed ^ (mixed >> np.uint32(15)), at[:-1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of bands; the band's number is part of it."""
    wide = sig.reshape(len(sig), BANDS, BAND_ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(77), wide.shape[:2])
    for k in range(BAND_ROWS):
        out = scramble(out ^ wide[:, :, k] + (out << np.uint64(17)))
    return out.view(np.int64)


def _filled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a shingle, their shingles, offsets)."""
    value, at = shingles(data, offsets)
    rows = np.flatnonzero(np.diff(at) > 0)
    return rows, value, np.append(at[rows], at[-1])


def _fingerprints(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    with np.errstate(over="ignore"):
        one = np.add.reduceat(scramble(value), at[:-1])
        two = np.bitwise_xor.reduceat(scramble(value + np.uint64(99)), at[:-1])
    return one.view(np.int64), two.view(np.int64)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j in blocks(offsets):
            rows, value, at = _filled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(rows):
                continue
            one, two = _fingerprints(value, at)
            sig = signatures(value, at)
            keys = band_keys(sig)
            low = pa.array([row.tobytes() for row in sig.astype(np.uint8)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * BANDS).astype(np.int32)), pa.array(keys.ravel()))
            size = pa.array(np.diff(at).astype(np.int64))
            yield pa.record_batch([batch.column(0).slice(i, j - i).take(pa.array(rows)), pa.array(one), pa.array(two), size, lists, low], ["doc_id", "f1", "f2", "size", "bands", "low"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """comp, rep, copies, parts, f1, text in; for the rows whose set has the hash f1, signature and shingles out."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(5))
        for i, j in blocks(offsets):
            rows, value, at = _filled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(rows):
                continue
            sig = signatures(value, at)
            own = batch.slice(i, j - i).take(pa.array(rows))
            right = np.flatnonzero(_fingerprints(value, at)[0] == own.column(4).to_numpy())
            body = [sig[k].tobytes() + value[at[k] : at[k + 1]].tobytes() for k in right.tolist()]
            own = own.take(pa.array(right))
            yield pa.record_batch([*(own.column(k) for k in range(4)), pa.array(body, pa.binary())], ["comp", "rep", "copies", "parts", "body"])


@functools.lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each CHUNK of values compared: a pair with fewer matches is dropped.

    With a uniform prior, m of n matches leave the similarity a Beta(m + 1, n - m + 1),
    whose mass above t is the chance of at most m successes in n + 1 trials at t.
    """
    out = []
    for n in range(CHUNK, VALUES + 1, CHUNK):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that pruning leaves; only i < j if both are the same block."""
    need = least_matches()
    left_i, left_j = [], []
    step = max(1, 4_000_000 // max(1, len(b) * CHUNK))
    for s in range(0, len(a), step):
        hits = (a[s : s + step, None, :CHUNK] == b[None, :, :CHUNK]).sum(2)
        ok = hits >= need[0]
        if same:
            ok &= np.arange(s, min(s + step, len(a)))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(ok)
        found = hits[i, j]
        i = i + s
        for k in range(1, len(need)):
            if not len(i):
                break
            found = found + (a[i, k * CHUNK : (k + 1) * CHUNK] == b[j, k * CHUNK : (k + 1) * CHUNK]).sum(1)
            keep = found >= need[k]
            i, j, found = i[keep], j[keep], found[keep]
        left_i.append(i)
        left_j.append(j)
    return (np.concatenate(left_i), np.concatenate(left_j)) if left_i else (np.zeros(0, np.int64),) * 2


def reaches(i: np.ndarray, j: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs have a Jaccard coefficient of at least the threshold, exactly."""
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if len(i) < 4 * (len(a) + len(b)):
        both = np.array([len(np.intersect1d(a[p], b[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        flat = np.concatenate([*a, *b])
        owner = np.repeat(np.arange(len(a) + len(b)), np.concatenate([size_a, size_b]))
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        number = np.cumsum(count > 1) - 1
        owner, column = owner[shared], number[column[shared]]
        width = int((count > 1).sum())
        total = np.zeros((len(a), len(b)), np.float32)
        for s in range(0, width, 4096):
            here = (column >= s) & (column < s + 4096)
            m = np.zeros((len(a) + len(b), min(4096, width - s)), np.float32)
            m[owner[here], column[here] - s] = 1
            total += m[: len(a)] @ m[len(a) :].T
        both = total[i, j].astype(np.int64)
    return both >= threshold * (size_a[i] + size_b[j] - both) - 1e-9


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each node the smallest node that links reach from it."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Lists of the rows that agree on their first three columns; rows come sorted by these."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key and held:
                yield held
                held = []
            key = row[:3]
            held.append(row)
    if held:
        yield held


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, x, y, part, rep, low) sorted by group (band, x, y), which holds blocks x and y of a band.

    Out: a, b, a spanning forest of the pairs that pruning leaves.
    """
    a, b = [], []
    for rows in _grouped(batches):
        _, x, y, *_ = rows[0]
        part, rep = np.array([r[3] for r in rows]), np.array([r[4] for r in rows], np.int64)
        low = np.stack([np.frombuffer(r[5], np.uint8) for r in rows])
        left, right = (np.flatnonzero(part == x), np.flatnonzero(part == y)) if x != y else (np.arange(len(rows)),) * 2
        i, j = surviving(low[left], low[right], x == y)
        root = _forest(len(rows), left[i], right[j])
        moved = np.flatnonzero(root != np.arange(len(rows)))
        a += rep[root[moved]].tolist()
        b += rep[moved].tolist()
        if len(a) > 20_000:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (comp, x, y, part, parts, rep, copies, body) sorted by group (comp, x, y), which holds blocks x and y of a component.

    Out: rep, root, links, whole (the group is the whole component).
    """

    def made(out: list[list]) -> pa.RecordBatch:
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.bool_())], ["rep", "root", "links", "whole"])

    out: list[list] = [[], [], [], []]
    for rows in _grouped(batches):
        rows.sort(key=lambda r: r[5])
        _, x, y, _, parts, *_ = rows[0]
        part = np.array([r[3] for r in rows])
        rep, copies = np.array([r[5] for r in rows], np.int64), np.array([r[6] for r in rows], np.int64)
        sig = np.stack([np.frombuffer(r[7], np.uint32, VALUES) for r in rows])
        sets = [np.frombuffer(r[7], np.uint64, offset=4 * VALUES) for r in rows]
        left, right = (np.flatnonzero(part == x), np.flatnonzero(part == y)) if x != y else (np.arange(len(rows)),) * 2
        i, j = surviving(sig[left], sig[right], x == y)
        if len(i):
            good = reaches(i, j, [sets[k] for k in left], [sets[k] for k in right])
            i, j = left[i[good]], right[j[good]]
        links = np.bincount(i, weights=copies[j], minlength=len(rows)) + np.bincount(j, weights=copies[i], minlength=len(rows))
        root, some = _forest(len(rows), i, j), links > 0
        for column, values in zip(out, (rep[some], rep[root[some]], links[some].astype(np.int64), np.full(int(some.sum()), parts == 1)), strict=True):
            column += values.tolist()
        if len(out[0]) > 20_000:
            yield made(out)
            out = [[], [], [], []]
    yield made(out)


def _block_pairs(df: DataFrame, group: str) -> DataFrame:
    """Every row once for each pair of blocks x <= y of its group that its own block, of `parts`, is one of; sorted for _grouped()."""
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    paired = df.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = [c for c in df.columns if c != group]
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paired.select(group, F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", *rest).repartition(width, group, "x", "y").sortWithinPartitions(group, "x", "y")


def _candidates(reps: DataFrame) -> DataFrame:
    """a, b: for each band a spanning forest of its members' pairs that pruning leaves."""
    banded = reps.select("rep", F.explode("bands").alias("band"))
    one, two = F.xxhash64("rep"), F.xxhash64(F.lit(5), "rep")
    fold = F.lit((1 << 31) - 1)
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.pmod(one, fold)).alias("s1"), F.sum(F.pmod(two, fold)).alias("s2")).where("n > 1")
    once = shared.groupBy("n", "s1", "s2").agg(F.min("band").alias("band"))
    parts = F.ceil(F.col("n") / BAND_BLOCK_ROWS).cast("int").alias("parts")
    members = banded.join(once.select("band", parts), "band").join(reps.select("rep", "low"), "rep").select("band", "rep", "low", "parts")
    return _block_pairs(members, "band").select("band", "x", "y", "part", "rep", "low").mapInArrow(_likely, "a long, b long")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, class_id, rep_id, n_links of every row of docs."""
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = slim.where(F.col("doc_id").isNotNull())
    digests = known.where(F.length("text") > 0).mapInArrow(_digest, "doc_id long, f1 long, f2 long, size long, bands array<long>, low binary")
    # One row for each id: rows that repeat it agree, or the smallest set hash stands for it. The table is written
    # behind this shuffle, so it is made once and the tasks that hash texts write no files of it.
    own = persisted(digests.groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "size", "bands", "low")).alias("d"), F.count("*").alias("rows")).select("doc_id", "d.*", "rows"))
    reps = persisted(own.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("size").alias("size"), F.min("bands").alias("bands"), F.min("low").alias("low"), F.max("rows").alias("rows")))
    met = components(_candidates(reps))
    members = met.join(reps.select("rep", "copies", "size", "f1"), met["node"] == F.col("rep")).select("rep", F.col("label").alias("comp"), "copies", "size", "f1")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.col("size") * 8) / BLOCK_SHINGLE_BYTES)).cast("int")
    members = persisted(members.join(members.groupBy("comp").agg(parts.alias("parts")), "comp").select("comp", "rep", "copies", "parts", "f1"))
    few = members.count() <= SENT_MEMBERS
    texts = known.join(F.broadcast(members) if few else members, F.col("rep") == F.col("doc_id")).select("comp", "rep", "copies", "parts", "f1", "text")
    sets = texts.mapInArrow(_sets, "comp long, rep long, copies long, parts int, body binary")
    if reps.where("rows > 1").limit(1).count():
        sets = sets.dropDuplicates(["rep"])  # a repeated row brings its text again
    grouped = _block_pairs(sets.select("comp", "rep", "copies", "parts", "body"), "comp").select("comp", "x", "y", "part", "parts", "rep", "copies", "body")
    found = grouped.mapInArrow(_compare, "rep long, root long, links long, whole boolean")
    found = persisted(found.repartition("rep"))  # few rows of many groups: without it a small file for each task
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = found.where("whole").select("rep", F.col("root").alias("label")).unionAll(components(found.where("NOT whole").select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "label"))
    of_rep = reps.select("f1", "f2", "rep", "copies").join(links, "rep", "left").join(labels, "rep", "left")
    of_doc = own.select("doc_id", "f1", "f2").join(of_rep, ["f1", "f2"]).select("doc_id", F.coalesce("label", "rep").alias("class_id"), F.col("rep").alias("rep_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return slim.select("doc_id").join(of_doc, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep_id", "doc_id").alias("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


#: Ids of dropped rows that are sent to workers (8 bytes each); more are joined by a shuffle.
SENT_DROPPED = 1_000_000


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one document of each class: the smallest id; all columns kept.

    Rows with a null id stay. Of rows that repeat a kept id one stays.
    """
    classes = persisted(join(docs, text, key).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.first("class_id").alias("class_id"), F.count("*").alias("rows")))
    dropped, repeated = free_name("__gone", docs.columns), free_name("__again", docs.columns)
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias(dropped))
    gone = F.broadcast(gone) if gone.count() <= SENT_DROPPED else gone
    kept = docs.join(gone, F.col(key).cast("long") == F.col(dropped), "left_anti")
    again = classes.where("doc_id = class_id AND rows > 1").select(F.col("doc_id").alias(repeated))
    if not again.limit(1).count():
        return kept
    repeats = F.col(key).cast("long") == F.col(repeated)
    return kept.join(again, repeats, "left_anti").unionByName(kept.join(again, repeats, "left_semi").dropDuplicates([key]))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s + 1 : s + 5], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS s FROM d WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y, c = p.n AND c = q.n AS equal FROM pairs JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y
  WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, links.y AS r FROM reach JOIN links ON links.x = reach.r),
c AS (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY doc_id),
l AS (SELECT x, count(*) AS n_links, min(CASE WHEN equal THEN y END) AS twin FROM links GROUP BY x)
SELECT d.doc_id, c.class_id, least(d.doc_id, coalesce(l.twin, d.doc_id)) AS rep_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links
FROM d JOIN c USING (doc_id) LEFT JOIN l ON l.x = d.doc_id
"""
