"""Document log-likelihood by a gated recurrent language model with a factored softmax.

Corpus counts. Tokens of all training documents are counted exactly, by a distributed
aggregation with map-side sums; the table of counts grows with the corpus and stays in
the shared folder. The most frequent tokens of it, at most KNOWN, are sent to workers;
other tokens get their counts by a join.

Model. The most frequent tokens, HEAD of them and more as the corpus grows (head_of), lie in
classes by frequency, small ones for frequent tokens; all others fall by their bytes into
TAILS further classes. The network, a GRU over token embeddings, gives the class by a
softmax and a head token by a softmax within its class; within a tail class a token has its
smoothed relative count. Biases start at the corpus counts, so the untrained network is the
unigram model.

Training. Each document is turned into ids once, in a table in the shared folder. Truncated
backpropagation in numpy goes over every token of every training document: documents of a
shard run side by side in lanes, in windows of STEPS, and the state is carried from window
to window to the end of each document (of each SEGMENT tokens of a longer one). It goes in rounds, more as the corpus grows
(rounds_of): a round takes the documents whose hash of id and tokens falls to it, every shard
of them trains from the same start, and the weights are averaged by the number of tokens.
Rounds, shards and their order follow from the rows alone, not from how they are partitioned.
PASSES such passes are made, whatever the size of the corpus.

Scoring. Whole documents, side by side in lanes, in windows of steps; the state is
carried from window to window to the end of each document.

Tokens are told apart by a 64-bit hash of their bytes; among V distinct tokens the
chance of any clash is V * V / 2 ** 65, 7e-7 for 5 million.

Defined results: a null text is an empty one, with the end token alone; rows with a
null id are held out; repeated rows count as often in training as they stand there and
score alike; without training rows the counts are 0 and all tokens equally unlikely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burin.llm.common import blocks, byte_set, held_out, persisted, text_buffers, words

HEAD, MOST_HEAD, TAILS, HIDDEN = 2048, 16_384, 8, 32
#: Tokens whose counts are sent to workers, at most (a table of 42 MB in each Python worker).
KNOWN = 1_000_000
#: How often training goes through the corpus, at every size alike; least number of rounds of a pass.
PASSES, ROUNDS = 1, 4
#: Rates of the first and the last round, and documents trained on side by side.
RATES, TRAIN_LANES = (4e-3, 1e-3), 256
#: Tokens of a document that are trained on one after the other.
SEGMENT = 4096
#: Tokens of a shard at most, times head / HEAD; shards of a round that are wanted, and tokens that each of them has at least.
SHARD_TOKENS, SHARDS, LEAST_TOKENS = 1_000_000, 8, 50_000
#: Documents that are scored side by side, bytes of them, and steps of a window.
LANES, SCORE_LANES, LANE_BYTES, STEPS = 3000, 512, 10 << 20, 32
#: States whose classes are looked at together, so that what is worked on stays in a core's cache.
ROWS = 2048
#: Tokens of a shard that are held at once; a shard of more (one row that repeats) is gone through in parts.
HELD_TOKENS = 4_000_000
ALPHA = 0.1

_TOKEN = ~byte_set((9, 13), (32, 32))
_PLAIN = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOG10 = float(np.log(10.0))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, tail class, text) of the tokens of a block of texts, without the ends."""
    start, end, key, row = words(data, offsets, _TOKEN)
    if not len(start):
        return key.astype(np.int64), row, row
    high = np.bitwise_or.reduceat(data, start) >= 0x80  # what lies between tokens is ASCII
    kind = high * 4 + ~_PLAIN[data[end - 1]] * 2 + (end - start > 8)
    return key.view(np.int64), kind.astype(np.int64), row


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, kind, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, kind, n = key[order], kind[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], kind[first], np.add.reduceat(n, first) if len(first) else n


def _distinct(key: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of a block in order, with their tail classes and how often they stand there."""
    found = pa.array(key).dictionary_encode()
    at, one = found.indices.to_numpy(), found.dictionary.to_numpy()
    kinds = np.zeros(len(one), np.int64)
    kinds[at] = kind
    order = np.argsort(one)
    return one[order], kinds[order], np.bincount(at, minlength=len(one))[order]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side sums: a row for each distinct token of a partition (or of 2 million held ones)."""
    empty = (np.zeros(0, np.int64),) * 3
    held, size = [empty], 0

    def out(rows) -> pa.RecordBatch:
        return pa.record_batch([pa.array(rows[0]), pa.array(rows[1].astype(np.int32)), pa.array(rows[2])], ["h", "kind", "c"])

    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        for i, j in blocks(offsets):
            key, kind, _ = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            held.append(_distinct(key, kind))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield out(held[0])
                    held, size = [empty], 0
    yield out(_summed(held))


@dataclass
class Corpus:
    """Counts: the end token's, sums by tail class without head tokens, and the known tokens."""

    tokens: int
    distinct: int
    ends: int
    tail_tokens: np.ndarray
    tail_distinct: np.ndarray
    head_size: int
    head_counts: np.ndarray
    slots: np.ndarray
    slot_count: np.ndarray
    slot_head: np.ndarray

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1 if not known here, place in the head or -1) of hashes."""
        mask = np.int64(len(self.slots) - 1)
        at = key & mask
        left = np.flatnonzero((self.slots[at] != key) & (self.slot_count[at] >= 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            left = left[(self.slots[at[left]] != key[left]) & (self.slot_count[at[left]] >= 0)]
        return self.slot_count[at], self.slot_head[at]

    @property
    def log_base(self) -> float:
        """log10 of what every base count is divided by."""
        return float(np.log10(self.tokens + ALPHA * (self.distinct + 1)))

    @property
    def log_tail(self) -> np.ndarray:
        return np.log10(self.tail_tokens + ALPHA * (self.tail_distinct + 1))


def gather(counts: DataFrame, ends: int, known: int = KNOWN) -> Corpus:
    """Sums of the table of counts, and its most frequent tokens, at most `known`."""
    step = F.floor(F.log("c") / F.log(F.lit(1.05)))
    sums = counts.groupBy("kind", step.alias("b")).agg(F.count("*").alias("n"), F.sum("c").alias("t")).collect()  # kinds x some hundred steps
    low, total = max((r["b"] for r in sums), default=0) + 1, 0
    for b in sorted({r["b"] for r in sums}, reverse=True):
        total += sum(r["n"] for r in sums if r["b"] == b)
        if total > known:
            break
        low = b
    got = counts.where(step >= low).select("h", "kind", "c").toArrow()  # at most `known` rows of three numbers
    key, kind, c = (got.column(i).to_numpy().astype(np.int64) for i in range(3))
    order = np.lexsort((key, -c))
    key, kind, c = key[order], kind[order], c[order]
    tail_tokens = np.array([sum(r["t"] for r in sums if r["kind"] == k) for k in range(TAILS)], float)
    tail_distinct = np.array([sum(r["n"] for r in sums if r["kind"] == k) for k in range(TAILS)], float)
    tokens_all = int(sum(r["t"] for r in sums)) + ends
    head = head_of(tokens_all)
    n_head = min(head - 1, len(key))
    np.subtract.at(tail_tokens, kind[:n_head], c[:n_head])
    np.subtract.at(tail_distinct, kind[:n_head], 1)
    size = 1 << max(8, int(2 * len(key)).bit_length())
    slots, slot_count, slot_head = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int32)
    at, left = key & (size - 1), np.arange(len(key))
    while len(left):
        free = left[slot_count[at[left]] < 0]
        _, one = np.unique(at[free], return_index=True)
        put = free[one]
        slots[at[put]], slot_count[at[put]] = key[put], c[put]
        slot_head[at[put]] = np.where(put < n_head, put + 1, -1)
        left = np.setdiff1d(left, put)
        at[left] = np.where(slot_count[at[left]] >= 0, (at[left] + 1) & (size - 1), at[left])
    return Corpus(tokens_all, int(sum(r["n"] for r in sums)) + (ends > 0), ends, tail_tokens, tail_distinct, head, np.concatenate([[ends], c[:n_head]]), slots, slot_count, slot_head)


def head_of(tokens: int) -> int:
    """Tokens that the network tells apart: HEAD, twice as many for each fourfold corpus over 32 million tokens, at most MOST_HEAD."""
    return min(MOST_HEAD, HEAD << max(0, int(np.floor(np.log2(max(1.0, tokens / 32e6)) / 2))))


def class_bounds(counts: np.ndarray, head: int) -> np.ndarray:
    """Bounds of the classes of head tokens by falling count: each holds about the same sum of square roots of counts.

    Frequent tokens so lie in small classes; there are about sqrt(head / 2) of them.
    """
    mass = np.cumsum(np.sqrt(np.concatenate([counts, np.zeros(max(0, head - len(counts)))])[:head] + 1.0))
    n = int(np.sqrt(head / 2))
    return np.unique(np.concatenate([[0], np.searchsorted(mass, mass[-1] * np.arange(1, n) / n) + 1, [head]]))


@dataclass
class Gru:
    """Token 0 is the end; inputs 0 .. head - 1 are head tokens, head .. the tail classes.

    bounds cut the head tokens into classes; the weights of a head token within its class
    are a row of member. The classes of the tail come after those of the head.
    """

    embed: np.ndarray
    recur: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    member: np.ndarray
    member_bias: np.ndarray
    bounds: np.ndarray

    @property
    def head(self) -> int:
        return len(self.member)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.recur, self.to_class, self.class_bias, self.member, self.member_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    def like(self, flat: np.ndarray) -> Gru:
        out, at = [], 0
        for own in self.weights():
            out.append(flat[at : at + own.size].reshape(own.shape).astype(np.float32))
            at += own.size
        return Gru(*out, self.bounds)

    def recurrent(self) -> tuple[np.ndarray, np.ndarray]:
        """The state's weights into the gates and into the candidate."""
        return self.recur[:, : 2 * HIDDEN].copy(), self.recur[:, 2 * HIDDEN :].copy()

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        """Output class of inputs (head tokens and tail classes)."""
        n = len(self.bounds) - 1
        table = np.concatenate([np.repeat(np.arange(n), np.diff(self.bounds)), n + np.arange(TAILS)]).astype(np.int16)
        return table[ids]


def fresh(corpus: Corpus, seed: int = 3) -> Gru:
    """Small random weights; biases at the unigram model."""
    rng = np.random.default_rng(seed)
    f = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    head = corpus.head_size
    counts = np.zeros(head)
    counts[: len(corpus.head_counts)] = corpus.head_counts
    bounds = class_bounds(corpus.head_counts, head)
    mass = np.concatenate([np.add.reduceat(counts, bounds[:-1]), corpus.tail_tokens]) + 0.5
    member = np.log(counts + ALPHA)
    member[len(corpus.head_counts) :] = -30
    return Gru(f(0.1, head + TAILS, 3 * HIDDEN), f(0.15, HIDDEN, 3 * HIDDEN), f(0.05, HIDDEN, len(mass)), np.log(mass / mass.sum()).astype(np.float32), f(0.05, head, HIDDEN), member.astype(np.float32), bounds)


def _sigmoid(x: np.ndarray) -> None:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _step(recur: tuple[np.ndarray, np.ndarray], h: np.ndarray, x: np.ndarray, gates: np.ndarray, v: np.ndarray, new: np.ndarray, out: np.ndarray) -> None:
    """The next state, into out; every array has a row for each lane.

    x holds the inputs' embeddings; the update and reset gates, h's part of the candidate
    and the candidate go into gates, v and new.
    """
    np.matmul(h, recur[0], out=gates)
    np.matmul(h, recur[1], out=v)
    gates += x[:, : 2 * HIDDEN]
    _sigmoid(gates)
    np.multiply(gates[:, HIDDEN:], v, out=new)
    new += x[:, 2 * HIDDEN :]
    np.tanh(new, out=new)
    np.subtract(h, new, out=out)
    out *= gates[:, :HIDDEN]
    out += new


def _softmax(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials, their sums by row, natural log of each target's share) of states, one a row.

    A state's entries are under 1 in size, so the largest logit is bounded by the weights
    alone; where that bound is too high to be taken off safely, each row's largest is.
    """
    size = np.abs(weights).sum(0)
    top = float((bias + size).max())
    x = states @ weights
    x += bias - np.float32(top)
    if top - float((bias - size).max()) > 60:
        x -= x.max(1, keepdims=True)
    own = x[np.arange(len(x)), target]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    return x, total, own - np.log(total)


def _by_class(net: Gru, k: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(order by class of what falls to the head classes, for each class met its bounds in it and among the members)."""
    n = len(net.bounds) - 1
    order = np.argsort(k, kind="stable")
    ends = np.searchsorted(k[order], np.arange(n + 1))
    return order[: ends[-1]], [(int(ends[c]), int(ends[c + 1]), int(net.bounds[c]), int(net.bounds[c + 1])) for c in range(n) if ends[c] < ends[c + 1]]


def likelihood(net: Gru, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the class, and for head tokens of the member, of each target."""
    k = net.class_of(target)
    out = np.concatenate([_softmax(states[i : i + ROWS], net.to_class, net.class_bias, k[i : i + ROWS])[2] for i in range(0, len(k), ROWS)]).astype(np.float64)
    order, classes = _by_class(net, k)
    s, y = states[order], target[order]
    for a, b, low, high in classes:
        out[order[a:b]] += _softmax(s[a:b], net.member[low:high].T, net.member_bias[low:high], y[a:b] - low)[2]
    return out


def score_ids(net: Gru, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of natural logs by document; ids of all documents, each closed by its end (0)."""
    order = np.argsort(-np.diff(offsets), kind="stable")
    total = np.zeros(len(order))
    for i in range(0, len(order), SCORE_LANES):
        own = order[i : i + SCORE_LANES]
        total[own] = _score_lanes(net, ids, offsets[:-1][own], np.diff(offsets)[own])
    return total


def _score_lanes(net: Gru, ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """score_ids of documents side by side, the longest first; the state goes on from window to window."""
    total, at, recur = np.zeros(len(first)), 0, net.recurrent()
    h, x, gates, v, new = (np.zeros((len(first), n * HIDDEN), np.float32) for n in (1, 3, 2, 1, 1))
    while at < length[0]:
        steps = min(max(STEPS, 8192 // int(np.searchsorted(-length, -at))), int(length[0]) - at)
        alive = np.searchsorted(-length, -np.arange(at, at + steps))
        ends = np.concatenate([[0], np.cumsum(alive)])
        lane = np.arange(ends[-1]) - np.repeat(ends[:-1], alive)
        now = first[lane] + np.repeat(np.arange(at, at + steps), alive)
        before = ids[now - 1]
        if at == 0:
            before[: ends[1]] = 0
        states = np.empty((ends[-1], HIDDEN), np.float32)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            np.take(net.embed, before[a:b], 0, x[: b - a], "clip")
            _step(recur, h[: b - a], x[: b - a], gates[: b - a], v[: b - a], new[: b - a], states[a:b])
            h = states[a:b]
        total += np.bincount(lane, weights=likelihood(net, states, ids[now]), minlength=len(total))
        at += steps
    return total


def gradients(net: Gru, ids: np.ndarray, valid: np.ndarray, h: np.ndarray):
    """Backpropagation through a window: ids (lanes, steps + 1), the first of a row being the input before it.

    Returns (gradient of the mean loss, last state, sum of the loss); states have a column
    for each lane. The gradient lists, for each array of weights, (rows that it moves, their gradient).
    """
    lanes, steps = ids.shape[0], ids.shape[1] - 1
    inputs, parts = ids[:, :-1].T.ravel(), net.recurrent()
    x = np.empty((lanes, 3 * HIDDEN), np.float32)
    gates, v, new, s = (np.empty((n, lanes, k * HIDDEN), np.float32) for n, k in ((steps, 2), (steps, 1), (steps, 1), (steps + 1, 1)))
    s[0] = h.T
    for t in range(steps):
        np.take(net.embed, inputs[t * lanes : (t + 1) * lanes], 0, x, "clip")
        _step(parts, s[t], x, gates[t], v[t], new[t], s[t + 1])
    states, y, w = s[1:].reshape(-1, HIDDEN), ids[:, 1:].T.ravel(), valid.T.ravel().astype(np.float32)
    scale = w / max(1.0, float(w.sum()))
    k = net.class_of(y)
    loss, to_class, class_bias, ds = 0.0, np.zeros_like(net.to_class), np.zeros_like(net.class_bias), np.empty_like(states)
    for i in range(0, len(y), ROWS):
        rows = slice(i, i + ROWS)
        e, total, own = _softmax(states[rows], net.to_class, net.class_bias, k[rows])
        loss -= float(own @ w[rows])
        e *= (scale[rows] / total)[:, None]
        e[np.arange(len(e)), k[rows]] -= scale[rows]
        to_class += states[rows].T @ e
        class_bias += np.ones(len(e), np.float32) @ e
        np.matmul(e, net.to_class.T, out=ds[rows])
    order, classes = _by_class(net, k)
    own_s, own_y, own_w, own_scale, own_ds = states[order], y[order], w[order], scale[order], ds[order]
    members, biases = [net.member[:0]], [net.member_bias[:0]]
    for a, b, low, high in classes:
        e, total, own = _softmax(own_s[a:b], net.member[low:high].T, net.member_bias[low:high], own_y[a:b] - low)
        loss -= float(own @ own_w[a:b])
        e *= (own_scale[a:b] / total)[:, None]
        e[np.arange(b - a), own_y[a:b] - low] -= own_scale[a:b]
        members.append(e.T @ own_s[a:b])
        biases.append(np.ones(len(e), np.float32) @ e)
        own_ds[a:b] += e @ net.member[low:high]
    ds[order] = own_ds
    ds = ds.reshape(steps, lanes, HIDDEN)
    back, down, one, two = np.zeros((lanes, HIDDEN), np.float32), *np.empty((3, lanes, HIDDEN), np.float32)
    to_gates, to_new = (np.ascontiguousarray(p.T) for p in parts)
    of_gates, of_new = (np.zeros_like(p) for p in parts)
    for t in range(steps - 1, -1, -1):  # the gradients of gates and candidate take their places
        z, r, n = gates[t, :, :HIDDEN], gates[t, :, HIDDEN:], new[t]
        back += ds[t]
        np.subtract(1, z, out=down)
        down *= back
        back *= z
        np.subtract(s[t], n, out=one)
        one *= down
        z *= one
        np.multiply(n, n, out=one)
        np.subtract(1, one, out=one)
        np.multiply(down, one, out=n)
        np.multiply(n, r, out=two)
        np.subtract(1, r, out=one)
        one *= v[t]
        np.multiply(one, two, out=r)
        back += np.matmul(gates[t], to_gates, out=one)
        back += np.matmul(two, to_new, out=one)
        of_gates += s[t].T @ gates[t]
        of_new += s[t].T @ two
    recur = np.concatenate([of_gates, of_new], 1)
    every = slice(None)
    met = every if len(classes) == len(net.bounds) - 1 else np.concatenate([np.arange(low, high) for _, _, low, high in classes] or [inputs[:0]])
    return [by_input(inputs, gates.reshape(-1, 2 * HIDDEN), new.reshape(-1, HIDDEN)), (every, recur), (every, to_class), (every, class_bias), (met, np.concatenate(members)), (met, np.concatenate(biases))], s[-1].T, loss


def by_input(inputs: np.ndarray, *columns: np.ndarray, few: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(distinct inputs in order, the sum of each one's rows over all columns); inputs of at most `few` rows are added up side by side."""
    order = np.argsort(inputs.astype(np.int16), kind="stable")
    read = inputs[order]
    first = np.flatnonzero(np.concatenate([[True], read[1:] != read[:-1]]))
    times = np.diff(np.append(first, len(read)))
    many, some, sums = np.flatnonzero(times > few), np.flatnonzero((times > 1) & (times <= few)), []
    for rows in columns:
        out, ones = rows.take(order[first], 0), np.ones(len(order), rows.dtype)
        for k in many:
            out[k] = ones[: times[k]] @ rows.take(order[first[k] : first[k] + times[k]], 0)
        left, nth = some, 1
        while len(left):
            out[left] += rows.take(order[first[left] + nth], 0)
            nth += 1
            left = left[times[left] > nth]
        sums.append(out)
    return read[first], np.concatenate(sums, 1)


class Adam:
    """Steps in place; rows that a window does not touch do not move."""

    def __init__(self, net: Gru, rate: float):
        self.rate, self.t = rate, 0
        self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]

    def step(self, net: Gru, gradient: list[tuple]) -> None:
        norm = float(np.sqrt(sum(float(np.vdot(g, g)) for _, g in gradient)))
        clip = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        self.t += 1
        one, two = np.float32(self.rate / (1 - 0.9**self.t)), np.float32(1 / (1 - 0.999**self.t))
        for weights, (rows, g), (m, v) in zip(net.weights(), gradient, self.moments, strict=True):
            g = g * clip
            first, second = m[rows] * np.float32(0.9), v[rows] * np.float32(0.999)
            first += np.float32(0.1) * g
            g *= g
            second += np.float32(0.001) * g
            m[rows], v[rows] = first, second
            second *= two
            np.sqrt(second, out=second)
            second += np.float32(1e-7)
            first /= second
            first *= one
            weights[rows] -= first


def train(net: Gru, adam: Adam, ids: np.ndarray, offsets: np.ndarray, lanes: int = TRAIN_LANES) -> int:
    """Adam, in place, over all tokens of documents, each closed by its end (0), in steps of STEPS; returns the tokens seen.

    The longest start first; a lane whose document ends takes the next one, with a new state.
    A document of more than SEGMENT tokens goes side by side in parts of so many.
    """
    parts = -(-np.diff(offsets) // SEGMENT)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    offsets = np.append(np.repeat(offsets[:-1], parts) + nth * SEGMENT, offsets[-1])
    full, queue, reach = np.concatenate([[0], ids]), np.argsort(-np.diff(offsets), kind="stable"), np.arange(STEPS + 1)
    first, last = offsets[:-1][queue], offsets[1:][queue]
    taken, seen = min(lanes, len(queue)), 0
    at, end = first[:taken].copy(), last[:taken].copy()
    h = np.zeros((HIDDEN, taken), np.float32)
    while len(at):
        valid = at[:, None] + reach[:-1] < end[:, None]
        window = full[np.minimum(at[:, None] + reach, len(ids))]
        g, h, _ = gradients(net, window, valid, h)
        adam.step(net, g)
        seen += int(valid.sum())
        at = at + STEPS
        into = np.flatnonzero(at >= end)[: len(queue) - taken]
        more = slice(taken, taken + len(into))
        at[into], end[into], h[:, into] = first[more], last[more], 0
        taken += len(into)
        left = at < end
        at, end, h = at[left], end[left], h[:, left]
    return seen


def closed(ids: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids with an end (0) after each document, n + 1 offsets) of the ids of n documents."""
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) + 1)])
    out = np.zeros(at[-1], np.int64)
    body = np.ones(len(out), bool)
    body[at[1:] - 1] = False
    out[body] = ids
    return out, at


def rounds_of(tokens: int) -> int:
    """Averaging rounds: one more for each doubling of the corpus over 16 million tokens."""
    return max(ROUNDS, int(np.ceil(np.log2(max(1, tokens) / 1e6))))


def _train_shards(start: Gru, rate: float, lanes: int):
    """shard, ids of documents sorted by shard in; for each shard its change of the weights times its tokens out."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, most, seen, net, adam = None, [], 0, 0, None, None

        def learn() -> int:
            at = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            return train(net, adam, np.concatenate(held).astype(np.int64), at, lanes)

        def out() -> pa.RecordBatch:
            change = (net.flat() - start.flat()) * np.float32(seen)
            return pa.record_batch([pa.array([shard % 8], pa.int32()), pa.array([change.tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["g", "change", "seen"])

        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and (own != shard or most > HELD_TOKENS):
                    seen += learn()
                    held, most = [], 0
                if own != shard:
                    if net is not None:
                        yield out()
                    shard, seen, net = own, 0, start.like(start.flat())
                    adam = Adam(net, rate)
                held.append(np.frombuffer(ids.as_buffer(), np.int16))
                most += len(held[-1])
        if held:
            seen += learn()
            yield out()

    return apply


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = None, 0
    for batch in batches:
        for raw, n in zip(batch.column(1), batch.column(2), strict=True):
            own = np.frombuffer(raw.as_buffer(), np.float32)
            total = own.astype(np.float64) if total is None else total + own
            seen += n.as_py()
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["change", "seen"])


def fit(rows: DataFrame, corpus: Corpus, passes: int = PASSES) -> Gru:
    """Weights from every token of every training document of `encoded` rows, averaged in rounds.

    A document's round and shard follow from a hash of its id and its ids, so that an id that
    many rows repeat is many shards, and a shard's documents are taken in the order of that
    hash: the weights do not depend on how the rows are partitioned.
    """
    net = fresh(corpus)
    if not corpus.ends:
        return net
    rounds = rounds_of(corpus.tokens)
    tokens_of_round = corpus.tokens // rounds
    shards = max(min(SHARDS, 1 + tokens_of_round // LEAST_TOKENS), int(tokens_of_round / (SHARD_TOKENS * corpus.head_size // HEAD)))
    lanes = min(TRAIN_LANES, max(16, corpus.ends // rounds // shards // 4))
    training = rows.where(~F.col("held_out"))
    by_row = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "doc_id", "ids"), F.lit(n))
    for r, rate in enumerate(np.linspace(*RATES, passes * rounds)):
        own = training.where(by_row(43, rounds) == r % rounds)
        dealt = own.select(by_row(47, shards).cast("int").alias("shard"), F.xxhash64("doc_id", "ids").alias("o"), "ids")
        parts = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "o", "ids").select("shard", "ids").mapInArrow(_train_shards(net, float(rate), lanes), "g int, change binary, seen long")
        sums = parts.repartition(8, "g").mapInArrow(_add_up, "change binary, seen long").collect()  # 8 sums of the weights' size
        if seen := sum(x["seen"] for x in sums):
            net = net.like(net.flat() + (sum(np.frombuffer(x["change"], np.float64) for x in sums) / seen).astype(np.float32))
    return net


def _encode(sent):
    """Every document's ids for the network, and what its base score and its tail tokens add up to."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = sent.value
        part, made = TaskContext.get().partitionId(), 0
        log_tail = corpus.log_tail * LOG10
        for batch in batches:
            data, all_offsets = text_buffers(batch.column(2))
            for i, j in _groups(all_offsets):
                offsets = all_offsets[i : j + 1] - all_offsets[i]
                n = j - i
                key, kind, row = (np.concatenate(c) for c in zip(*_token_blocks(data[all_offsets[i] : all_offsets[j]], offsets), strict=True))
                c, head = corpus.look_up(key)
                known, tail = c >= 0, head < 0
                count = np.bincount(row, minlength=n)
                ids, at = closed(np.where(tail, corpus.head_size + kind, head), row, n)
                raw = ids.astype(np.int16).tobytes()
                log_c = np.where(known, np.log(np.where(known, c, 0) + ALPHA), 0)
                of_tail = np.bincount(row, weights=np.where(tail, log_c - log_tail[kind], 0), minlength=n) / LOG10
                base = np.bincount(row, weights=log_c, minlength=n) / LOG10 + np.log10(corpus.ends + ALPHA) - (count + 1) * corpus.log_base
                rest = np.flatnonzero(~known)
                order = rest[np.lexsort((key[rest], row[rest]))]
                new = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])])) if len(order) else order
                cuts = np.searchsorted(row[order][new], np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int64))) for x in (key[order][new], np.diff(np.append(new, len(order))))]
                n_known = np.bincount(row, weights=known & (c > 0), minlength=n).astype(np.int64) + (corpus.ends > 0)
                rid = (np.int64(part) << np.int64(40)) + made + np.arange(n)
                made += n
                own = batch.slice(i, n)
                sizes = at.tolist()
                bodies = pa.array([raw[2 * a : 2 * b] for a, b in zip(sizes[:-1], sizes[1:], strict=True)], pa.binary())
                yield pa.record_batch([pa.array(rid), own.column(0), own.column(1), pa.array(count + 1), pa.array(n_known), pa.array(base), pa.array(of_tail), bodies, *lists], ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "of_tail", "ids", "rest", "times"])

    return apply


def _score(net: Gru):
    """The column ids (the last) becomes the network's log10 probability of them."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.num_columns - 1))
            model = np.zeros(batch.num_rows)
            for i, j in blocks(offsets, LANE_BYTES):
                ids = data[offsets[i] : offsets[j]].view(np.int16).astype(np.int64)
                model[i:j] = score_ids(net, ids, (offsets[i : j + 1] - offsets[i]) // 2) / LOG10
            yield pa.record_batch([*batch.columns[:-1], pa.array(model)], [*batch.schema.names[:-1], "model"])

    return apply


def _groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for i, j in blocks(offsets, LANE_BYTES):
        for k in range(i, j, LANES):
            yield k, min(j, k + LANES)


def _token_blocks(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = [tokens(data[:0], offsets[:1])]
    for i, j in blocks(offsets):
        key, kind, row = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out.append((key, kind, row + i))
    return out


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", known: int = KNOWN, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("doc_id"), held_out(key, 10, 0).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    training = slim.where(~F.col("held_out"))
    parts = training.select("text").mapInArrow(_counts, "h long, kind int, c long")
    counts = persisted(parts.groupBy("h").agg(F.first("kind").alias("kind"), F.sum("c").alias("c")))
    corpus = gather(counts, training.count(), known)
    kind = slim.schema["doc_id"].dataType.simpleString()
    head = f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, of_tail double"
    encode = _encode(spark.sparkContext.broadcast(corpus))
    rows = persisted(slim.mapInArrow(encode, head + ", ids binary, rest array<long>, times array<long>"))
    net = fit(rows, corpus, passes)
    scored = rows.drop("rest", "times").mapInArrow(_score(net), head + ", model double")
    rare = rows.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("t")).select("rid", F.col("t.rest").alias("h"), F.col("t.times").alias("times"))
    log_c = F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(ALPHA))
    extra = rare.join(counts.select("h", "c"), "h", "left").groupBy("rid").agg(F.sum(log_c).alias("log_c"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("more"))
    joined = scored.join(extra, "rid", "left")
    log_c = F.coalesce(F.col("log_c"), F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log_c).alias("base_score"), (F.col("model") + F.col("of_tail") + log_c).alias("score"),
    )
