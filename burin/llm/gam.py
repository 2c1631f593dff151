"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a short vector of shape features. The model is a lookup table for
each feature's bins and for the bins of a few pairs of features, learned by cyclic
boosting: each round visits the features in turn and fits a shallow tree on one
feature's histogram, later rounds do so on pairs. A score is a sum of looked-up
values, computed for a batch by vectorised additions, through the logistic function.

Defined results: a null text is scored as an empty one; repeated rows score alike;
rows without labels are scored too. Labels that are null, of a null id or of the
held-out fold are not learned from. Without labels every score is 0.5. Other
columns of the tables are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burin.llm.common import blocks, byte_set, held_out, persisted, powers, sampled, scramble, text_buffers, words

FEATURES = (
    "log_bytes", "log_tokens", "token_length", "upper", "digits", "punctuation", "symbols", "exclaims", "non_ascii", "space",
    "log_lines", "log_line_length", "line_repeats", "distinct_tokens", "top_token", "short_tokens", "long_tokens", "pair_repeats", "stops", "commas",
)
#: Bound of the training sample (labelled rows), bins of a feature, pairs kept, bins of a pair's side.
MOST_LABELS, BINS, PAIRS, PAIR_BINS = 20_000, 32, 6, 8
CUT = 0.7

_SPACE = byte_set((9, 13), (32, 32))
_UPPER, _LOWER = byte_set((65, 90)), byte_set((97, 122))
_PUNCT = byte_set((33, 47), (58, 64), (91, 96), (123, 126))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|<>{}[]\\^~_@=+")] = True
_CLASSES = np.zeros((256, 8), np.float32)
for _i, _c in enumerate((_UPPER, _LOWER, byte_set((48, 57)), _PUNCT, _SYMBOL, byte_set((33, 33)), byte_set((128, 255)), _SPACE)):
    _CLASSES[_c, _i] = 1


def _repeats(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, occurrences of the most frequent key) by row."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    with np.errstate(over="ignore"):
        mixed = np.sort((scramble(key ^ scramble(row.astype(np.uint64))) & np.uint64(0xFFFFFFFFFF)) | (row.astype(np.uint64) << np.uint64(40)))
    new = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
    sizes = np.diff(np.append(new, len(mixed)))
    at = (mixed[new] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, at, sizes)
    return np.bincount(at, minlength=n).astype(float), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(n, len(FEATURES)) of n whole texts."""
    n, length = len(offsets) - 1, np.diff(offsets).astype(float)
    counts = np.stack([np.bincount(np.repeat(np.arange(n), np.diff(offsets)), weights=_CLASSES[data, k], minlength=n) for k in range(8)], 1) if len(data) else np.zeros((n, 8))
    upper, lower, digits, punct, symbols, bangs, wide, space = counts.T
    start, end, key, row = words(data, offsets, ~_SPACE, fold=False)
    size = (end - start).astype(float)
    tokens = np.bincount(row, minlength=n).astype(float)
    some, lines_of = np.maximum(tokens, 1), words(data, offsets, ~byte_set((10, 10)), fold=False)
    distinct, top = _repeats(row, key, n)
    lines = np.bincount(lines_of[3], minlength=n).astype(float)
    distinct_lines, _ = _repeats(lines_of[3], lines_of[2], n)
    together = row[1:] == row[:-1]
    with np.errstate(over="ignore"):
        pairs, _ = _repeats(row[1:][together], (key[:-1] * powers(2)[1] + key[1:])[together], n)
    n_pairs = np.bincount(row[1:][together], minlength=n)
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    share = lambda mask: np.bincount(row, weights=mask, minlength=n) / some
    full = np.maximum(length, 1)
    return np.stack([
        np.log1p(length), np.log1p(tokens), np.bincount(row, weights=size, minlength=n) / some, upper / np.maximum(upper + lower, 1), digits / full,
        punct / full, symbols / full, bangs / full, wide / full, space / full, np.log1p(lines), np.log1p(length / np.maximum(lines, 1)),
        1 - distinct_lines / np.maximum(lines, 1), distinct / some, top / some, share(size <= 3), share(size >= 14), 1 - pairs / np.maximum(n_pairs, 1),
        share((last == 46) | (last == 33) | (last == 63)), share(last == 44),
    ], 1)


@dataclass
class Gam:
    """edges: inner bounds of each feature's bins; tables: one value a bin; pairs: (a, b, edges of a, edges of b, table)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, k], side="right")]
        for a, b, ea, eb, values in self.pairs:
            total += values[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A tree of `depth` on an ordered histogram: one value a bin."""
    out = np.full(len(g), -g.sum() / (h.sum() + ridge))
    if depth and len(g) > 1:
        lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        rg, rh = g.sum() - lg, h.sum() - lh
        gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
            out[:k], out[k:] = _shallow(g[:k], h[:k], depth - 1, ridge), _shallow(g[k:], h[k:], depth - 1, ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best tree of one cut on each side of a grid: (values, gain)."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, values = 0.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            sums = [(s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j]) for s in (cg, ch)]
            gain = sum(a * a / (b + ridge) for a, b in zip(*sums, strict=True))
            if gain > best:
                best, v = gain, [-a / (b + ridge) for a, b in zip(*sums, strict=True)]
                values = np.empty_like(g)
                values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = v
    return values, best


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 15, rate: float = 0.15, ridge: float = 1.0) -> Gam:
    """Cyclic boosting of the logistic loss; interactions after the main effects."""
    if not len(y):
        return Gam()
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(p0 / (1 - p0))))
    model.edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    codes = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    f = np.full(len(y), model.base)
    for _ in range(rounds):
        for k, code in enumerate(codes):
            p = 1 / (1 + np.exp(-f))
            size = len(model.tables[k])
            step = rate * _shallow(np.bincount(code, weights=p - y, minlength=size), np.bincount(code, weights=p * (1 - p), minlength=size), 2, ridge)
            model.tables[k] += step
            f += step[code]
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    low = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p, shape = 1 / (1 + np.exp(-f)), (len(coarse[a]) + 1, len(coarse[b]) + 1)
        both = low[a] * shape[1] + low[b]
        return tuple(np.bincount(both, weights=w, minlength=shape[0] * shape[1]).reshape(shape) for w in (p - y, p * (1 - p)))

    ranked = sorted(((_quadrants(*grids(a, b), ridge)[1], -a, -b) for a in range(x.shape[1]) for b in range(a) if len(coarse[a]) and len(coarse[b])), reverse=True)
    chosen = [(-a, -b) for gain, a, b in ranked[:PAIRS] if gain > 0]
    tables = {ab: np.zeros((len(coarse[ab[0]]) + 1, len(coarse[ab[1]]) + 1)) for ab in chosen}
    for _ in range(pair_rounds):
        for a, b in chosen:
            step = rate * _quadrants(*grids(a, b), ridge)[0]
            tables[a, b] += step
            f += step[low[a], low[b]]
    model.pairs = [(a, b, coarse[a], coarse[b], tables[a, b]) for a, b in chosen]
    return model


def _features_of(keep: list[str]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
            x = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets)]
            x = np.concatenate(x) if x else np.zeros((0, len(FEATURES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in keep), lists], [*keep, "x"])

    return apply


def _scores_of(model: Gam, keep: list[str], cut: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = model.score(x)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*kept, pa.array(score), pa.array((score >= cut).astype(np.int32))], [*keep, "score", "predicted"])

    return apply


def _kept_types(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in keep)


def featured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, x of every row, written once and read for both fitting and scoring."""
    slim = docs.select(F.col(key).alias("doc_id"), held_out(key, 4, 2).alias("held_out"), F.col(text).cast("string").alias("text"))
    keep = ["doc_id", "held_out"]
    return persisted(slim.mapInArrow(_features_of(keep), _kept_types(slim, keep) + "x array<double>"))


def fit(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", bound: int = MOST_LABELS) -> Gam:
    """Fit on at most `bound` labels, chosen by a hash of their ids, joined to the features of `rows`."""
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out(key, 4, 2))
    few = sampled(known, bound, 23, "doc_id")  # at most `bound` rows of two numbers: small enough to send
    return _trained(rows.where(~F.col("held_out")).join(F.broadcast(few), "doc_id"), bound)


def _trained(rows: DataFrame, bound: int) -> Gam:
    """Train on doc_id, x, y of the labelled sample, in a fixed order; of an id that repeats one row, so `bound` rows at most."""
    once = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.x", "r.y")
    got = once.limit(bound).toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, got.column("doc_id").to_numpy())) if got.num_rows else np.zeros(0, int)
    return train(x[order], (y[order] >= 1).astype(float))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    rows = featured(docs, text, key)
    model = fit(rows, labels, key)
    keep = ["doc_id", "held_out"]
    return rows.mapInArrow(_scores_of(model, keep, cut), _kept_types(rows, keep) + "score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", cut: float = CUT, bound: int = MOST_LABELS) -> DataFrame:
    """The rows of docs that score at least `cut`, all columns kept.

    Features are computed for the labelled sample, to fit, and once for every row.
    """
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out(key, 4, 2))
    few = sampled(known, bound, 23, "doc_id")
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    model = _trained(slim.mapInArrow(_features_of(["doc_id", "y"]), _kept_types(slim, ["doc_id", "y"]) + "x array<double>"), bound)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            good = [model.score(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) >= cut for i, j in blocks(offsets)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(apply, docs.schema)
