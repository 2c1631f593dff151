"""Language identification by a byte convolutional network.

A text is cut into windows of WINDOW bytes that overlap by the widest filter
less one, so every n-gram of the whole text lies inside a window. Each window
goes through filters of several widths over byte embeddings, a rectifier, max
pooling over the window and a softmax; the text's probabilities are the mean
over its windows. Training is numpy on labelled windows; scoring is batched.

Defined results: a null text, an empty one and one without any letter give
`und` with score 0. Repeated rows are scored alike. Without a single labelled
row every text is `und`. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burin.llm.common import blocks, free_name, held_out, powers, scramble, text_buffers

WIDTHS = (2, 3, 4, 5)
WINDOW, STEP = 256, 252
EMBED, FILTERS = 8, 8
UNDETERMINED = "und"
#: Training goes on over few windows until so many steps are made.
LEAST_STEPS = 400
#: Bounds of the training sample: texts of a language, windows of a text, texts of all languages.
TEXTS_PER_LANG, WINDOWS_PER_TEXT, MOST_TEXTS = 800, 4, 200_000
#: Languages whose shares are sent to every task (some 3 MB); those of more are joined as any table.
MOST_SENT = 100_000


@dataclass
class ByteCNN:
    """embed (257, EMBED), row 256 is padding; filters ((widest * EMBED), len(WIDTHS) * FILTERS)."""

    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    def mask(self) -> np.ndarray:
        """The taps that each filter's width leaves at zero."""
        out = np.zeros_like(self.filters)
        for k, width in enumerate(WIDTHS):
            out[: width * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        return out


def fresh(langs: list[str], seed: int = 7) -> ByteCNN:
    rng = np.random.default_rng(seed)
    wide, n = max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS
    f = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = ByteCNN(langs, f(0.5, 257, EMBED), f(0.25, wide, n), np.zeros(n, np.float32), f(0.1, n, len(langs)), np.zeros(len(langs), np.float32))
    net.embed[256] = 0
    net.filters *= net.mask()
    return net


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((n, WINDOW) byte codes padded with 256, row of each window) of whole texts."""
    lengths = np.diff(offsets)
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STEP)), 0)
    row = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + nth * STEP
    at = start[:, None] + np.arange(WINDOW)
    codes = data[np.minimum(at, max(len(data) - 1, 0))].astype(np.int16) if len(row) else np.zeros((0, WINDOW), np.int16)
    codes[at >= offsets[row + 1][:, None]] = 256
    return codes, row


def columns(net: ByteCNN, codes: np.ndarray) -> np.ndarray:
    """Each position's next max(WIDTHS) embeddings side by side: (n, WINDOW, widest * EMBED)."""
    widest = max(WIDTHS)
    padded = np.full((len(codes), WINDOW + widest - 1), 256, np.int16)
    padded[:, :WINDOW] = codes
    flat = net.embed[padded]
    s = flat.strides
    view = np.lib.stride_tricks.as_strided(flat, (len(codes), WINDOW, widest * EMBED), (s[0], s[1], s[2]))
    return np.ascontiguousarray(view)


def pooled(net: ByteCNN, codes: np.ndarray, want_at: bool = False):
    cols = columns(net, codes)
    act = (cols.reshape(-1, cols.shape[2]) @ net.filters).reshape(len(codes), WINDOW, -1)
    if not want_at:
        return np.maximum(act.max(1) + net.shift, 0)
    at = act.argmax(1)
    return np.maximum(np.take_along_axis(act, at[:, None], 1)[:, 0] + net.shift, 0), at, cols


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def window_probabilities(net: ByteCNN, codes: np.ndarray, at_once: int = 96) -> np.ndarray:
    out = np.empty((len(codes), len(net.langs)), np.float32)
    for i in range(0, len(codes), at_once):
        out[i : i + at_once] = softmax(pooled(net, codes[i : i + at_once]) @ net.dense + net.bias)
    return out


def train(codes: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 3, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteCNN:
    """Adam on the cross entropy of windows, each language weighing the same."""
    net = fresh(langs, seed)
    rng, mask = np.random.default_rng(seed + 1), net.mask()
    names = ("embed", "filters", "shift", "dense", "bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    weight = 1 / np.maximum(np.bincount(labels, minlength=len(langs)), 1)
    weight = (weight / (weight[labels].mean() or 1)).astype(np.float32)
    step = 0
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // max(1, len(labels)))) if len(labels) else 0):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x, y = codes[pick], labels[pick]
            hidden, at, cols = pooled(net, x, want_at=True)
            err = softmax(hidden @ net.dense + net.bias)
            err[np.arange(len(y)), y] -= 1
            err *= (weight[y] / len(y))[:, None]
            back = (err @ net.dense.T) * (hidden > 0)
            g = {"dense": hidden.T @ err, "bias": err.sum(0), "shift": back.sum(0)}
            taken = cols[np.arange(len(y))[:, None], at]
            g["filters"] = np.einsum("nf,nfe->ef", back, taken, optimize=True) * mask
            to = (back[:, :, None] * net.filters.T[None]).reshape(-1, max(WIDTHS), EMBED)
            pos = (at[:, :, None] + np.arange(max(WIDTHS))).reshape(-1, max(WIDTHS))
            byte = np.where(pos < WINDOW, x[np.repeat(np.arange(len(y)), at.shape[1])[:, None], np.minimum(pos, WINDOW - 1)], 256)
            g["embed"] = np.stack([np.bincount(byte.ravel(), weights=to[:, :, k].ravel(), minlength=257) for k in range(EMBED)], 1).astype(np.float32)
            g["embed"][256] = 0
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                change = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - change).astype(np.float32))
    return net


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS_PER_TEXT windows of each text, chosen by a hash of their bytes, whatever stands beside them."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        for i, j in blocks(offsets):
            codes, row = windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            with np.errstate(over="ignore"):
                rank = scramble((codes.astype(np.uint64) * powers(WINDOW)).sum(1))
            order = np.lexsort((rank, row))
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            keep = order[nth < WINDOWS_PER_TEXT]
            langs = batch.column(1).slice(i, j - i).take(pa.array(row[keep]))
            yield pa.record_batch([pa.array(rank[keep].view(np.int64)), pa.array([c.tobytes() for c in codes[keep]], pa.binary()), langs.cast(pa.string())], ["rank", "codes", "lang"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", texts_per_lang: int = TEXTS_PER_LANG, epochs: int = 3) -> ByteCNN:
    """Fit on a bounded sample: about texts_per_lang texts of each language, fewer where that makes more than MOST_TEXTS.

    WINDOWS_PER_TEXT windows from anywhere in a text reach the driver, so the sample
    is bounded in bytes too. Texts and windows are chosen by hashes, so the sample is the
    same however the rows are partitioned. Rows of the held-out fold (crc32 modulo 4 is 2), and rows
    with a null id, text or language, are not learned from.
    """
    known = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k")).where(~held_out("k", 4, 2) & F.col("t").isNotNull() & F.col("l").isNotNull() & (F.length("t") > 0))
    counts = known.groupBy("l").count().collect()  # a row for each language
    langs = sorted(r["l"] for r in counts)
    if not langs:
        return fresh([UNDETERMINED])
    texts_per_lang = max(1, min(texts_per_lang, MOST_TEXTS // len(langs)))
    unit = 1 << 30
    # A table of a row a language, joined: the plan stays as small with thousands of languages. Texts are not shuffled for it.
    shares = docs.sparkSession.createDataFrame([(r["l"], min(unit, int(unit * texts_per_lang / r["count"]))) for r in counts], known.select(F.col("l"), F.lit(0).cast("long").alias("share")).schema)
    chosen = known.join(F.broadcast(shares) if len(langs) <= MOST_SENT else shares, "l").where(F.pmod(F.xxhash64(F.lit(11), "k"), F.lit(unit)) < F.col("share"))
    taken = chosen.select("t", "l").mapInArrow(_sample_windows, "rank long, codes binary, lang string")
    got = taken.orderBy("rank", "lang").limit(2 * len(langs) * texts_per_lang * WINDOWS_PER_TEXT).toArrow()
    codes = np.frombuffer(b"".join(got.column("codes").to_pylist()), np.int16).reshape(-1, WINDOW)
    index = {name: i for i, name in enumerate(langs)}
    labels = np.array([index[x] for x in got.column("lang").to_pylist()], np.int64)
    return train(codes, labels, langs, epochs)


def predict(docs: DataFrame, net: ByteCNN, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of keep (default: all of docs) with the two results appended.

    The network (some 10 kB and 33 numbers a language) travels in the closure.
    """
    keep = list(docs.columns) if keep is None else keep
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    body, flag = (text if text in keep else free_name("__text", keep)), free_name("__has_letter", keep)
    out = "".join(f"`{c}` {types[c]}, " for c in keep) + f"`{names[0]}` string, `{names[1]}` double"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            data, offsets = text_buffers(column[body])
            n = batch.num_rows
            total = np.zeros((n, len(net.langs)))
            for i, j in blocks(offsets):
                codes, row = windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                p = window_probabilities(net, codes)
                for k in range(p.shape[1]):
                    total[i:j, k] = np.bincount(row, weights=p[:, k], minlength=j - i)
            letters = np.array(column[flag].to_pylist(), bool)
            weight = total.sum(1)
            ok = letters & (weight > 0) & (net.langs != [UNDETERMINED])
            share = total / np.where(weight > 0, weight, 1)[:, None]
            best = share.argmax(1)
            lang = [net.langs[b] if good else UNDETERMINED for b, good in zip(best, ok, strict=True)]
            score = np.where(ok, np.clip(share[np.arange(n), best], 0, 1), 0.0)
            yield pa.record_batch([*(column[c] for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    extra = {flag: F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))} | ({} if text in keep else {body: F.col(text)})
    return docs.select(*[F.col(c) for c in keep], *[v.alias(k) for k, v in extra.items()]).mapInArrow(apply, out)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    net = fit(docs, text, lang, key)
    slim = docs.select(F.col(key).alias("doc_id"), held_out(key, 4, 2).alias("held_out"), F.col(text).alias("text"))
    return predict(slim, net, keep=["doc_id", "held_out"])


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", least: float = 0.4) -> DataFrame:
    """The rows of docs whose language is determined, with a score of at least `least`; all columns kept."""
    names = (free_name("__lang_pred", docs.columns), free_name("__lang_score", docs.columns))
    told = predict(docs, fit(docs, text, lang, key), text, names=names)
    return told.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= least)).drop(*names)
