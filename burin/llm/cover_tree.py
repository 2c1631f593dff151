"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, floor(1024 * x). Every row goes to the part of its nearest pivot (a
bounded sample of rows), which has the pivot as centre and a measured radius; queries of parts
that stand side by side are a group, and large parts and groups are split by a hash. A pair of a group and a part
is a cell: one set of rows of one shuffle, queries before candidates. The k-th score of a query
among the sample is a first bound: a query goes only to the parts that can hold a candidate with
that score, and a part only to the groups with such a query. A task
builds the cover tree of a cell's queries, then cover trees over bounded runs of its candidates
as they come, and walks both trees together: a pair of nodes goes when even its best inner
product, from the two centres and covering radii, stays below the worst k-th score among the
queries under the query node. What is left of a cell is the k best of every query; these meet in
one ranking by query. The driver sees the sample, and two counts and the radius of each part; the
plan is the same at every size, and a task holds CELL_QUERIES queries and one run.

Defined results: rows with a null id, a null vector, or a null, NaN or infinite
component take no part, nor do empty vectors; vectors of different lengths have no
score together. Ties go to the smaller vec_id. Every row that is a query is asked, every
row but itself is its candidate, so rows that repeat an id each have their ranks and each
keep their place. An integer score beyond 53 bits raises an ArithmeticError rather than
being rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burin.llm.common import persisted

#: Rows under one tree of candidates, rows of a leaf, children of a node.
RUN, LEAF, FANOUT = 8192, 48, 48
#: Queries and candidates of a cell, about.
CELL_QUERIES, CELL_ROWS = 8192, 64 * RUN
#: Pivots, at most (larger parts are split, so tables of any size have cells of the same size), and rows of the sample: at least, and for each pivot.
MOST_PIVOTS, LEAST_SAMPLE, SAMPLE = 2048, 1024, 8
#: Shares of one part that a cell's number has room for.
SHARES = 1 << 24
#: Numbers in a block of distances to pivots.
BLOCK = 1 << 22
#: Partitions of the cells; more cells than that share them.
MOST_PARTITIONS = 100_000


@dataclass
class CoverTree:
    """points in tree order, place[i] the row that the i-th was; node i covers points[start[i]:end[i]], all within radius[i] of centre[i], which is one of them."""

    points: np.ndarray
    place: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray


def build(points: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> CoverTree:
    """A cover tree in float64 of integer points.

    Nesting: a node's centre is the centre of its first child. Separation: its children's
    centres lie further than half its radius from each other. Covering: every point is under
    the child whose centre is nearest, within half the radius, or, once there are `fanout`
    children, within that child's radius, which is measured. A node of at most `leaf` points,
    or of equal ones, is a leaf. The root's centre is the point nearest the mean.
    """
    order = np.arange(len(points))
    rows: list[tuple[int, float, int, int, int, int]] = []
    centres: list[int] = []
    queue = [(0, len(points), int(((points - points.mean(0)) ** 2).sum(1).argmin()))]
    at = 0
    while at < len(queue):
        a, b, centre = queue[at]
        at += 1
        own = order[a:b]
        x = points[own]
        dist, owner = ((x - points[centre]) ** 2).sum(1), np.zeros(b - a, np.int64)
        radius = float(np.sqrt(dist.max()))
        first = n = 0
        if b - a > leaf and radius > 0:
            chosen = [centre]
            while len(chosen) < fanout:
                pick = int(dist.argmax())
                if dist[pick] <= radius * radius / 4:
                    break
                d = ((x - x[pick]) ** 2).sum(1)
                closer = d < dist
                dist[closer], owner[closer] = d[closer], len(chosen)
                chosen.append(int(own[pick]))
            order[a:b] = own[np.argsort(owner, kind="stable")]
            first, n = len(queue), len(chosen)
            ends = a + np.cumsum(np.bincount(owner, minlength=n))
            queue += zip([a, *ends[:-1].tolist()], ends.tolist(), chosen, strict=True)
        centres.append(centre)
        rows.append((a, radius, a, b, first, n))
    _, radius, start, end, child, children = (np.array(c) for c in zip(*rows, strict=True))
    centre = points[centres]
    return CoverTree(points[order], order, centre, radius, np.sqrt((centre**2).sum(1)), start, end, child, children)


class Best:
    """The k best candidates so far of each query of a tree, in tree order; `least` is a score that k candidates, here or elsewhere, reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k = k
        self.score = np.full((len(least), k), -np.inf)
        self.id = np.full((len(least), k), np.iinfo(np.int64).max)
        self.score[:, -1] = least

    def offer(self, a: int, b: int, scores: np.ndarray, ids: np.ndarray) -> None:
        some = (scores >= self.score[a:b, -1:]).any(0)
        if not some.any():
            return
        s = np.concatenate([self.score[a:b], scores[:, some]], 1)
        i = np.concatenate([self.id[a:b], np.broadcast_to(ids[some], (b - a, int(some.sum())))], 1)
        top = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[a:b], self.id[a:b] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)


@dataclass
class Rows:
    """A tree with the id and the row number of each of its points."""

    tree: CoverTree
    ids: np.ndarray
    numbers: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, numbers: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Rows:
        tree = build(points, leaf)
        return Rows(tree, ids[tree.place], numbers[tree.place])


def _bound(q: CoverTree, node: int, d: CoverTree, nodes: np.ndarray) -> np.ndarray:
    """No pair under (node, nodes) has a larger inner product."""
    r = q.radius[node]
    up = d.centre[nodes] @ q.centre[node] + r * d.norm[nodes] + q.norm[node] * d.radius[nodes] + r * d.radius[nodes]
    return up + 1e-9 * np.abs(up) + 1e-3


def _below(tree: CoverTree, nodes: np.ndarray) -> np.ndarray:
    """Leaves stay, other nodes are replaced by their children."""
    n = tree.children[nodes]
    inner, n = nodes[n > 0], n[n > 0]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.concatenate([nodes[tree.children[nodes] == 0], np.repeat(tree.child[inner], n) + step])


def search(queries: Rows, rows: Rows, best: Best) -> None:
    """Fold the candidates among rows into best, query group by query group; no row is its own candidate."""
    q, d = queries.tree, rows.tree
    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        node, front = stack.pop()
        a, b = int(q.start[node]), int(q.end[node])
        if q.children[node]:
            front = _below(d, front)
            front = front[_bound(q, node, d, front) >= best.score[a:b, -1].min()]
            if len(front):
                first = int(q.child[node])
                stack += [(c, front) for c in range(first, first + int(q.children[node]))]
            continue
        while len(front):
            bound = _bound(q, node, d, front)
            keep = bound >= best.score[a:b, -1].min()
            front, bound = front[keep], bound[keep]
            if not len(front):
                break
            order = np.argsort(-bound)
            now, front = front[order[:16]], front[order[16:]]
            leaf = d.children[now] == 0
            if leaf.any():
                under = np.concatenate([np.arange(d.start[i], d.end[i]) for i in now[leaf]])
                scores = q.points[a:b] @ d.points[under].T
                scores[queries.numbers[a:b, None] == rows.numbers[under]] = -np.inf
                best.offer(a, b, scores, rows.ids[under])
            front = np.concatenate([_below(d, now[~leaf]), front])


def integers(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(1024 * x) as float64) of the usable vectors, one pair for each length."""
    if not len(vectors):
        return
    flat = vectors.values
    at = np.asarray(vectors.offsets, np.int64)
    x = np.floor(1024.0 * flat.to_numpy(zero_copy_only=False).astype(np.float64))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    length = np.diff(at)
    good = (bad[at[1:]] == bad[at[:-1]]) & (length > 0) & np.array(vectors.is_valid())
    for n in np.unique(length[good]):
        rows = np.flatnonzero(good & (length == n))
        out = x[at[rows][:, None] + np.arange(n)]
        if len(out) and float(np.abs(out).max()) ** 2 * n >= 2.0**53:
            raise ArithmeticError("inner products of these vectors do not fit in 53 bits")
        yield rows, out


@dataclass
class Dealt:
    """Rows (number, vec_id, v, part, g, p) by group and share of a part; by length of vector the names and centres of pivots and the ids and vectors of the sample; (part, rows, queries, radius) of each part."""

    rows: DataFrame
    pivots: dict[int, tuple[np.ndarray, np.ndarray]]
    sample: dict[int, tuple[np.ndarray, np.ndarray]]
    parts: list


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to each row's nearest centre."""
    best, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    half = (centres**2).sum(1) / 2
    step = max(1, BLOCK // len(centres))
    for i in range(0, len(x), step):
        own = x[i : i + step]
        best[i : i + step] = (own @ centres.T - half).argmax(1)
        far[i : i + step] = np.sqrt(((own - centres[best[i : i + step]]) ** 2).sum(1))
    return best, far


def _place(pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in integers(batch.column("v")):
                # Vectors of a length that no pivot has are one part, with no bound.
                part, far = np.full(len(x), -x.shape[1]), np.full(len(x), np.inf)
                if x.shape[1] in pivots:
                    names, centres = pivots[x.shape[1]]
                    near, far = _nearest(x, centres)
                    part = names[near]
                taken = batch.take(pa.array(rows))
                yield pa.record_batch([*taken.columns, pa.array(part, pa.int64()), pa.array(far)], [*taken.schema.names, "part", "far"])

    return apply


def deal(rows: DataFrame, every: int, key: str, vector: str, cell_queries: int = CELL_QUERIES, cell_rows: int = CELL_ROWS) -> Dealt:
    """The usable rows by part, written once, so that a row's number is the same wherever it is read."""
    spark = rows.sparkSession
    slim = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    asked = F.col("vec_id") % every == 0
    held, wanted = slim.agg(F.count("*"), F.count_if(asked)).first()
    groups = max(1, -(-wanted // cell_queries))
    pivots = min(MOST_PIVOTS, max(-(-held // cell_rows), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)))
    size = max(LEAST_SAMPLE, SAMPLE * pivots)
    chance = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(1 << 30))
    # A few times the sample pass the hash; no task sorts more than them.
    some = slim.withColumn("chance", chance).where(F.col("chance") < int(min(1.0, 4 * size / max(1, held)) * (1 << 30))).orderBy("chance").limit(size)
    sample: dict[int, list] = {}
    for batch in some.select("vec_id", "v").toArrow().to_batches():
        for at, x in integers(batch.column("v")):
            sample.setdefault(x.shape[1], []).append((batch.column("vec_id").to_numpy()[at], x))
    known = {length: tuple(np.concatenate(c) for c in zip(*found, strict=True)) for length, found in sorted(sample.items())}
    named, n = {}, 0
    for length, (_, x) in known.items():
        # Each length has its share of the pivots.
        c = np.unique(x[: max(1, pivots * len(x) // size)] if len(known) > 1 or len(x) > pivots else x[:pivots], axis=0)
        named[length] = (np.arange(n, n + len(c)), c)
        n += len(c)
    kind = slim.schema["v"].dataType.simpleString()
    placed = persisted(slim.withColumn("number", F.monotonically_increasing_id()).mapInArrow(_place(named), f"vec_id long, v {kind}, number long, part long, far double"))
    parts = placed.groupBy("part").agg(F.count("*").alias("rows"), F.count_if(asked).alias("queries"), F.max("far").alias("radius")).collect()
    groups = _groups(named, {r["part"]: r["queries"] for r in parts}, cell_queries)
    shares = spark.createDataFrame([(r["part"], -(-r["rows"] // cell_rows), groups[r["part"]], -(-r["queries"] // cell_queries)) for r in parts], "part long, row_shares int, group long, query_shares int")
    salted = lambda of, salt, n: F.col(of) * SHARES + F.pmod(F.xxhash64(F.lit(salt), "number"), F.greatest(n, F.lit(1)))
    out = placed.join(F.broadcast(shares), "part").withColumns({"asked": asked, "g": salted("group", 1, F.col("query_shares")), "p": salted("part", 2, F.col("row_shares"))})
    return Dealt(out, named, known, parts)


def _groups(pivots: dict[int, tuple[np.ndarray, np.ndarray]], queries: dict[int, int], most: int) -> dict[int, int]:
    """A group for each part: pivots in a chain, each the nearest of those left, cut where `most` queries are reached; other parts are alone."""
    out, group, held = {p: p for p in queries if p < 0}, 0, 0
    for names, centres in pivots.values():
        left, now = np.ones(len(names), bool), 0
        for _ in range(len(names)):
            left[now] = False
            n = queries.get(int(names[now]), 0)
            if held and held + n > most:
                group, held = group + 1, 0
            held += n
            if int(names[now]) in queries:
                out[int(names[now])] = group
            if left.any():
                now = int(np.where(left, ((centres - centres[now]) ** 2).sum(1), np.inf).argmin())
        group, held = group + 1, 0
    return out


def _searched(queries: DataFrame, candidates: DataFrame, k: int, run: int, cells: int) -> DataFrame:
    """(number, query_id, vec_id, score): the k best of each query of each cell; both have (g, p, number, vec_id, v), queries also least."""
    names = ["g", "p", "side", "number", "vec_id", "v", "least"]
    both = queries.withColumn("side", F.lit(0)).select(names).unionAll(candidates.withColumns({"side": F.lit(1), "least": F.lit(None).cast("long")}).select(names))
    dealt = both.repartition(max(1, min(cells, MOST_PARTITIONS)), "g", "p").sortWithinPartitions("g", "p", "side")
    return dealt.mapInArrow(_search_cells(k, run), "number long, query_id long, vec_id long, score long")


def _shares(part, count):
    """A row for each of a part's shares, with its number."""
    return F.explode(F.sequence(part * SHARES, part * SHARES + count - 1))


def reach(dealt: Dealt, k: int) -> DataFrame:
    """The queries with `least`, a score that k rows of the sample reach (null without), and `reached`: the parts that can hold a candidate with that score."""
    kind = dealt.rows.schema["v"].dataType.simpleString()
    radius = {r["part"]: r["radius"] for r in dealt.parts}
    # A pivot without rows has the radius -1.
    bounds = {n: (names, c, np.array([radius.get(int(i), -1.0) for i in names])) for n, (names, c) in dealt.pivots.items()}
    sample = dealt.sample

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column("vec_id").to_numpy(), batch.column("part").to_numpy()
            least, found = np.full(len(own), -np.inf), [[int(p)] for p in own]
            for rows, x in integers(batch.column("v")):
                if x.shape[1] not in bounds:
                    continue
                names, centres, r = bounds[x.shape[1]]
                others, vectors = sample[x.shape[1]]
                step = max(1, BLOCK // max(len(names), len(others)))
                for i in range(0, len(rows), step):
                    at, q = rows[i : i + step], x[i : i + step]
                    if len(others) >= k:
                        # A sampled row with the query's id may be the query itself.
                        scores = np.where(others == ids[at][:, None], -np.inf, q @ vectors.T)
                        least[at] = np.partition(scores, -k, axis=1)[:, -k]
                    up = q @ centres.T + np.sqrt((q**2).sum(1))[:, None] * r
                    up += 1e-9 * np.abs(up) + 1e-3
                    hit = (up >= least[at][:, None]) & (r >= 0)
                    for j, row in zip(at, hit, strict=True):
                        found[j] = names[row].tolist()
            floor = pa.array(np.where(np.isfinite(least), least, 0).astype(np.int64), pa.int64(), mask=~np.isfinite(least))
            yield pa.record_batch([*batch.columns, floor, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "least", "reached"])

    asked = dealt.rows.where("asked").select("number", "vec_id", "v", "part", "g")
    return persisted(asked.mapInArrow(apply, f"number long, vec_id long, v {kind}, part long, g long, least long, reached array<bigint>"))


def top_k(rows: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", cell_queries: int = CELL_QUERIES, cell_rows: int = CELL_ROWS, run: int = RUN) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, a row whose key is divisible by `every`."""
    dealt = deal(rows, every, key, vector, cell_queries, cell_rows)
    shares = dealt.rows.sparkSession.createDataFrame([(r["part"], -(-r["rows"] // cell_rows)) for r in dealt.parts], "to long, row_shares int")
    sent = reach(dealt, k).withColumn("to", F.explode("reached")).join(F.broadcast(shares), "to").withColumn("p", _shares(F.col("to"), F.col("row_shares")))
    # Cells with a query; a part's rows meet them share by share, so that no join key holds more than a cell's rows.
    cells = sent.select("g", "p").distinct()
    found = _searched(sent, dealt.rows.drop("g").join(cells, "p"), k, run, cells.count())
    by = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class _Cell:
    """One cell's queries and their best, by length of vector; candidates are searched a run at a time."""

    def __init__(self, k: int, run: int):
        self.k, self.run = k, run
        self.asked: dict[int, list] = {}
        self.held: dict[int, list] = {}
        self.queries: dict[int, tuple[Rows, Best]] | None = None

    def take(self, side: int, ids: np.ndarray, numbers: np.ndarray, vectors: pa.Array, least: np.ndarray) -> None:
        if side and self.queries is None:
            self.queries = {n: self.started(x) for n, x in self.asked.items()}
        for rows, x in integers(vectors):
            n = x.shape[1]
            if not side:
                self.asked.setdefault(n, []).append((ids[rows], numbers[rows], x, least[rows]))
            elif n in self.queries:
                self.held.setdefault(n, []).append((ids[rows], numbers[rows], x))
                if sum(len(c[0]) for c in self.held[n]) >= self.run:
                    self.flush(n)

    def started(self, parts: list) -> tuple[Rows, Best]:
        own = self.joined([c[:3] for c in parts], 16)
        return own, Best(np.concatenate([c[3] for c in parts])[own.tree.place], self.k)

    @staticmethod
    def joined(parts: list, leaf: int = LEAF) -> Rows:
        return Rows.of(*(np.concatenate(c) for c in zip(*parts, strict=True)), leaf=leaf)

    def flush(self, n: int) -> None:
        search(self.queries[n][0], self.joined(self.held.pop(n)), self.queries[n][1])

    def results(self) -> Iterator[pa.RecordBatch]:
        for n in list(self.held):
            self.flush(n)
        for own, best in (self.queries or {}).values():
            q, j = np.nonzero((best.score > -np.inf) & (best.id < np.iinfo(np.int64).max))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (own.numbers[q], own.ids[q], best.id[q, j], best.score[q, j].astype(np.int64))], ["number", "query_id", "vec_id", "score"])


def _search_cells(k: int, run: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at = None, None
        for batch in batches:
            g, p, side, numbers, ids = (batch.column(i).to_numpy() for i in range(5))
            least = batch.column(6).cast(pa.float64()).fill_null(-np.inf).to_numpy()
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(p) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
                if a == b:
                    continue
                if (g[a], p[a]) != at:
                    if cell:
                        yield from cell.results()
                    cell, at = _Cell(k, run), (g[a], p[a])
                for i in range(a, b, run):
                    j = min(b, i + run)
                    cell.take(int(side[a]), ids[i:j], numbers[i:j], batch.column(5).slice(i, j - i), least[i:j])
        if cell:
            yield from cell.results()

    return apply


SQL = """
WITH ok AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.n AS n, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON c.n <> q.n AND len(c.v) = len(q.v)
  WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
