"""Personal data: spans of fixed patterns, and more spans by a semi-Markov conditional random field.

Base spans (email, ip, card, phone) are found in the bytes of whole blocks. What they leave is
looked at where digits or signs of an address stand: such a place is a window, a sequence of
units (groups of digits, or words and marks), between base spans, which stay. A candidate is a
run of at most MOST_UNITS units as a whole: its score for a kind comes from features of the whole
span (the pattern of its groups and separators, its number of digits, its check digit, whether
its parts can be an address, what stands beside it, a cue word before it). A dynamic programme
over the units chooses boundaries and kinds together: each unit is outside or in one candidate,
and neighbours' kinds have weights of their own.

The weights maximise the conditional log-likelihood (forward and backward sums over all ways to
cut a window, in numpy) of windows of the corpus whose base spans are the truth, at most
MOST_WINDOWS of them, chosen by a hash of their content over all documents, together with
windows made by rule: the same kinds as people write them (without +, with other separators,
broken lines, spelled-out signs, two beside each other) and numbers that are none (dates, times,
versions, amounts, ranges, failing check digits). The model is a table of KINDS * BUCKETS
weights, whatever the corpus is.

Defined results: a null text is an empty one; rows stay as they are, repeats and null ids too,
and no other column is looked at. A pattern never reaches from one text into the next. Added
spans touch no base span and no other added one. Texts are taken whole; memory follows a block
or its one longest text.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burin.llm.common import blocks, text_buffers

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
BUCKETS, MOST_UNITS, MOST_WINDOWS, MADE_WINDOWS, STEPS = 8192, 24, 512, 1000, 100
#: Groups of digits that one span holds at most, digits from which a window is looked at.
MOST_GROUPS, LEAST_DIGITS = 7, 7

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_AFTER_PLUS = re.compile(rb"[0-9][ ().0-9-]++")
_GAP = np.zeros(256, bool)
_GAP[list(b" +().-/[]\n\r\t")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True

Span = tuple[int, int, int]  # start, kind, end


@dataclass
class Digits:
    """Groups of digits of a block: bounds and text of each; no group spans two texts."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Digits:
        at = np.flatnonzero((data >= 48) & (data <= 57))
        row = np.searchsorted(offsets, at, side="right") - 1
        edge = np.ones(len(at), bool)
        edge[1:] = (np.diff(at) > 1) | (np.diff(row) > 0)
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(at)) - 1
        return Digits(at[first], at[last] + 1 if len(at) else at, row[first])

    def runs(self, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in groups of the runs whose neighbours are linked (one flag between each two)."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], ~linked]))
        return first, np.append(first[1:], len(self.start))


def luhn(digits: bytes) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(twice[c - 48] if i & 1 else c - 48 for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(data: np.ndarray, offsets: np.ndarray, digits: Digits | None = None) -> list[list[Span]]:
    """Spans of the fixed patterns in byte offsets of the block, by text, in order."""
    raw, out = data.tobytes(), [[] for _ in range(len(offsets) - 1)]
    g = digits or Digits.of(data, offsets)
    row_of = lambda at: int(np.searchsorted(offsets, at, side="right")) - 1

    done = 0
    for p in np.flatnonzero(data == 64).tolist():
        row = row_of(p)
        low = max(done, int(offsets[row]))
        start = low + len(raw[low:p].rstrip(_LOCAL))
        found = _DOMAIN.match(raw, p + 1, int(offsets[row + 1])) if start < p else None
        done = found.end() if found else p + 1
        if found:
            out[row].append((start, EMAIL, done))

    gap = g.start[1:] - g.end[:-1]
    same = np.diff(g.row) == 0
    between = data[np.minimum(g.end[:-1], max(0, len(data) - 1))] if len(gap) else np.zeros(0, np.uint8)
    first, last = g.runs(same & (gap == 1) & (between == 46))
    for a, b in zip(first[last - first > 3].tolist(), last[last - first > 3].tolist(), strict=True):
        for i in range(a, b - 3, 4):
            start, end = int(g.start[i]), int(g.end[i + 3])
            if all(_small(part) for part in raw[start:end].split(b".")):
                out[int(g.row[i])].append((start, IP, end))

    first, last = g.runs(same & (gap == 1) & ((between == 32) | (between == 45)))
    n = np.concatenate([[0], np.cumsum(g.end - g.start)])
    count = n[last] - n[first]
    for a, b in zip(first[(count > 13) & (count < 20)].tolist(), last[(count > 13) & (count < 20)].tolist(), strict=True):
        start, end = int(g.start[a]), int(g.end[b - 1])
        if luhn(raw[start:end].translate(None, b" -")):
            out[int(g.row[a])].append((start, CARD, end))

    for p in np.flatnonzero(data == 43).tolist():
        row = row_of(p)
        found = _AFTER_PLUS.match(raw, p + 1, int(offsets[row + 1]))
        if found:
            whole = found[0].rstrip(b" ().-")
            if len(whole) > 2 and 10 <= len(whole.translate(None, b" ().-")) <= 15:
                out[row].append((p, PHONE, p + 1 + len(whole)))
    for spans in out:
        spans.sort()
    return out


def _small(part: bytes) -> bool:
    return len(part := part.lstrip(b"0")) < 4 and int(part or b"0") < 256


# --- windows -----------------------------------------------------------------------------------


@dataclass
class Window:
    """n units; candidates (first unit, end unit, kind, key, start, end), the key holding all that the features see."""

    n: int
    candidates: list[tuple[int, int, int, tuple, int, int]] = field(default_factory=list)


# Words before a span that tell its kind, and common endings of host names.
CUES = {
    "mail": EMAIL, "email": EMAIL, "contact": EMAIL, "correo": EMAIL, "ip": IP, "host": IP, "server": IP, "from": IP, "card": CARD, "visa": CARD, "mastercard": CARD, "karte": CARD,
    "tarjeta": CARD, "carte": CARD, "tel": PHONE, "phone": PHONE, "call": PHONE, "fax": PHONE, "mobile": PHONE, "telefon": PHONE, "telefono": PHONE,
}
ENDINGS = {b"com", b"org", b"net", b"edu", b"gov", b"io", b"de", b"fr", b"es", b"uk", b"info", b"eu", b"us"}
_LAST_WORD = re.compile(rb"([A-Za-z]+)[^A-Za-z]{0,3}\Z")


def _cue(raw: bytes, low: int, at: int) -> int:
    found = _LAST_WORD.search(raw, max(low, at - 20), at)
    return CUES.get(found[1].decode().lower(), -1) if found else -1


def _side(raw: bytes, at: int, low: int, high: int) -> str:
    if not low <= at < high:
        return "edge"
    c = raw[at]
    return "blank" if c in b" \n\r\t" else "word" if _ALNUM[c] else "mark" if c in b".,:;!?)]}\"'|" else "sign"


_PREFIX = re.compile(rb"(?:\+ ?)?\(?\Z")


def number_windows(raw: bytes, data: np.ndarray, offsets: np.ndarray, g: Digits, taken: np.ndarray) -> Iterator[tuple[int, Window]]:
    """(text, window) of each run of digit groups that are not taken, with marks only between them."""
    if not len(g.start):
        return
    glued = np.zeros(len(g.start), bool)
    before, after = np.maximum(g.start - 1, 0), np.minimum(g.end, len(data) - 1)
    glued |= (g.start > offsets[g.row]) & _ALNUM[data[before]]
    glued |= (g.end < offsets[g.row + 1]) & _ALNUM[data[after]]
    out = glued | taken
    gap = g.start[1:] - g.end[:-1]
    linked = (np.diff(g.row) == 0) & (gap <= 4) & ~out[1:] & ~out[:-1]
    for k in range(4):
        at = np.minimum(g.end[:-1] + k, max(0, len(data) - 1))
        linked &= (gap <= k) | _GAP[data[at]]
    first, last = g.runs(linked)
    n = np.concatenate([[0], np.cumsum(g.end - g.start)])
    some = (n[last] - n[first] >= LEAST_DIGITS) & ~out[first]
    for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True):
        row = int(g.row[a])
        yield row, _numbers(raw, int(offsets[row]), int(offsets[row + 1]), g.start[a:b].tolist(), g.end[a:b].tolist())


def _numbers(raw: bytes, low: int, high: int, starts: list[int], ends: list[int]) -> Window:
    n = len(starts)
    lengths = [b - a for a, b in zip(starts, ends, strict=True)]
    out = Window(n)
    for i in range(n):
        prefix = _PREFIX.search(raw, max(low, starts[i] - 3, ends[i - 1] if i else low), starts[i])[0]
        total, shape = 0, []
        for j in range(i, min(n, i + MOST_GROUPS)):
            total += lengths[j]
            shape.append(lengths[j])
            if total > 19:
                break
            if total < LEAST_DIGITS and j - i != 3:
                shape.append(raw[ends[j] : starts[j + 1]].decode() if j + 1 < n else "")
                continue
            start, end = starts[i], ends[j]
            kinds = [PHONE] if LEAST_DIGITS <= total <= 15 else []
            if 13 <= total:
                kinds.append(CARD)
            if j - i == 3 and max(shape[::2]) < 4:
                kinds.append(IP)
            if kinds:
                text = raw[start:end]
                parts = tuple(shape)
                good = 13 <= total and luhn(re.sub(rb"[^0-9]", b"", text))
                address = IP in kinds and all(int(raw[starts[k] : ends[k]]) < 256 for k in range(i, j + 1))
                right = _side(raw, end, low, high)
                for kind in kinds:
                    own = prefix if kind == PHONE else b""
                    at = start - len(own)
                    zeros = text.startswith(b"00")
                    key = (own.decode() + "00" * zeros, parts, good, address, _side(raw, at - 1, low, high), right, _cue(raw, low, at))
                    out.candidates.append((i, j + 1, kind, key, at, end))
            shape.append(raw[ends[j] : starts[j + 1]].decode() if j + 1 < n else "")
    return out


_SIGN = re.compile(rb"@|[\[({] ?(?:at|dot|AT|DOT) ?[\])}]| (?:dot|DOT) ")
_UNIT = re.compile(rb"(?P<A>[\[({] ?(?:at|AT) ?[\])}])|(?P<D>[\[({] ?(?:dot|DOT) ?[\])}])|(?P<t>(?<![^ ])(?:at|AT)(?![^ ]))|(?P<d>(?<![^ ])(?:dot|DOT)(?![^ ]))|(?P<w>[A-Za-z0-9_%+-]+)|(?P<_> )|(?P<o>[^ ])")
_ADDRESS = re.compile(r"w(?:\.w)*_?[@At]_?w(?:(?:\.|_?[Dd]_?|_\._)w)+")
#: Bytes that a window shows on each side of a sign.
AROUND = 80


def address_windows(raw: bytes, offsets: np.ndarray, base: list[list[Span]]) -> Iterator[tuple[int, Window]]:
    """(text, window) around signs of addresses that no base span holds."""
    reach = 0
    for found in _SIGN.finditer(raw):
        at = found.start()
        if at < reach:
            continue
        row = int(np.searchsorted(offsets, at, side="right")) - 1
        low, high = int(offsets[row]), int(offsets[row + 1])
        if found.end() > high:
            continue
        a, b = max(low, reach, at - AROUND), min(high, at + AROUND)
        for start, _, end in base[row]:
            if start <= at < end:
                a = b = at
            elif end <= at:
                a = max(a, end)
            elif start > at:
                b = min(b, start)
        if a < b:
            # Words at the edges are whole, but for words longer than a window.
            while a > low and a > at - 2 * AROUND and _ALNUM[raw[a - 1]] and a != reach and _ALNUM[raw[a]]:
                a -= 1
            while b < high and b < at + 2 * AROUND and _ALNUM[raw[b - 1]] and _ALNUM[raw[b]]:
                b += 1
            reach = b
            yield row, _addresses(raw, low, high, a, b)


def _addresses(raw: bytes, low: int, high: int, a: int, b: int) -> Window:
    units = [(m.lastgroup if m.lastgroup != "o" else chr(m[0][0]) if m[0][0] < 128 else "o", m.start(), m.end()) for m in _UNIT.finditer(raw, a, b)]
    shape = "".join(u[0] if u[0] not in "wADtd_" or len(u[0]) == 1 else "o" for u in units)
    out = Window(len(units))
    for i, c in enumerate(shape):
        if c != "w":
            continue
        for j in range(i + 3, min(len(units), i + MOST_UNITS) + 1):
            if shape[j - 1] != "w" or not _ADDRESS.fullmatch(shape, i, j):
                continue
            start, end = units[i][1], units[j - 1][2]
            ending = raw[units[j - 1][1] : end].lower()
            whole = j == len(units) or shape[j] != "." or j + 1 >= len(units) or shape[j + 1] != "w"
            key = (shape[i:j], ending in ENDINGS, ending.isalpha() and 2 <= len(ending) <= 8, whole, i > 0 and shape[i - 1] in ".-@", _side(raw, end, low, high), _cue(raw, low, start))
            out.candidates.append((i, j, EMAIL, key, start, end))
    return out


def features(kind: int, key: tuple) -> list[int]:
    """Buckets of the features of a whole span."""
    if kind == EMAIL:
        shape, ending, tail, whole, glued, right, cue = key
        marks = re.sub("[w_.]", "", shape)
        names = [f"shape {shape}", f"marks {marks}", f"ending {ending} {tail}", f"whole {whole}", f"glued {glued}", f"right {right}", f"cue {cue}", f"blank {'_' in shape}", f"signs {marks[:1]} {ending}", f"labels {shape.count('w')}", f"end {ending} {whole} {'d' in shape}"]
    else:
        prefix, parts, good, address, left, right, cue = key
        groups, gaps = parts[::2], parts[1::2][: len(parts) // 2]
        n = sum(groups)
        uniform = len(set(gaps)) < 2
        marks = "".join(sorted(set("".join(gaps))))
        round_ = prefix + "".join(gaps)
        names = [
            f"shape {prefix} {parts}", f"groups {groups}", f"gaps {prefix} {gaps}", f"digits {n}", f"marks {marks}", f"n groups {len(groups)}", f"check {good} {13 <= n <= 19}", f"check {good} {n} {len(groups)}",
            f"address {address} {marks}", f"address {address}", f"prefix {prefix}", f"prefix {prefix} {n}", f"round {round_.count('(') == round_.count(')')}", f"lines {chr(10) in round_}", f"left {left}", f"right {right}", f"cue {cue}",
            f"uniform {uniform} {good}", f"least {min(groups)} {len(groups)} {good}",
        ]
    return [zlib.crc32(f"{kind} {name}".encode()) % BUCKETS for name in ["bias", *names]]


# --- model -------------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights of features by bucket, and of a kind beside the one before it (0: outside)."""

    weights: np.ndarray
    beside: np.ndarray
    known: dict = field(default_factory=dict)

    def score(self, kind: int, key: tuple) -> float:
        found = self.known.get((kind, key))
        if found is None:
            if len(self.known) > 1 << 16:
                self.known.clear()
            found = self.known[kind, key] = float(self.weights[features(kind, key)].sum())
        return found

    def best(self, window: Window) -> list[Span]:
        """Spans of the best way to cut a window."""
        n, kinds = window.n, len(KINDS) + 1
        ends: list[list] = [[] for _ in range(n + 1)]
        for c in window.candidates:
            ends[c[1]].append((*c, self.score(c[2], c[3])))
        if not window.candidates:
            return []
        value = np.full((n + 1, kinds), -np.inf)
        value[0, 0] = 0
        came: list[list] = [[None] * kinds for _ in range(n + 1)]
        for j in range(1, n + 1):
            into = value[j - 1] + self.beside[:, 0]
            y = int(into.argmax())
            value[j, 0], came[j][0] = into[y], (j - 1, y, None)
            for i, _, kind, _, start, end, score in ends[j]:
                into = value[i] + self.beside[:, kind + 1]
                y = int(into.argmax())
                if into[y] + score > value[j, kind + 1]:
                    value[j, kind + 1], came[j][kind + 1] = into[y] + score, (i, y, (start, kind, end))
        j, y, out = n, int(value[n].argmax()), []
        while j:
            j, y, span = came[j][y]
            if span:
                out.append(span)
        return out[::-1]


class Batch:
    """Windows of one kind of units, padded, with the features of their distinct keys."""

    def __init__(self, examples: list[tuple[Window, set[Span]]]):
        self.n = np.array([w.n for w, _ in examples])
        keys: dict = {}
        rows = [(e, i, j, k, keys.setdefault((k, key), len(keys)), (a, k, b) in gold) for e, (w, gold) in enumerate(examples) for i, j, k, key, a, b in w.candidates]
        self.e, self.i, self.j, self.k, self.key, self.gold = (np.array(c) for c in zip(*rows, strict=True))
        lists = [features(k, key) for k, key in keys]
        self.features = np.full((len(lists), max(map(len, lists))), BUCKETS)
        for at, f in enumerate(lists):
            self.features[at, : len(f)] = f
        order = np.lexsort((self.i, self.j))
        for name in ("e", "i", "j", "k", "key", "gold"):
            setattr(self, name, getattr(self, name)[order])
        self.by_end = [np.flatnonzero(self.j == j) for j in range(int(self.n.max()) + 1)]
        self.by_start = [np.flatnonzero(self.i == i) for i in range(int(self.n.max()) + 1)]

    def gradient(self, weights: np.ndarray, beside: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the gold cuts and its gradients."""
        score = np.append(weights, 0.0)[self.features].sum(1)[self.key]
        m, most, kinds = len(self.n), int(self.n.max()), len(KINDS) + 1
        a = np.full((m, most + 1, kinds), -np.inf)
        a[:, 0, 0] = 0
        z = np.full((m, most + 1, kinds), -np.inf)
        z[np.arange(m), self.n] = 0
        lse = np.logaddexp.reduce
        with np.errstate(invalid="ignore"):
            into = np.full((m, most + 1, kinds), -np.inf)  # sums over the kind before, by the kind that comes
            for j in range(most + 1):
                if j:
                    a[:, j, 0] = into[:, j - 1, 0]
                    s = self.by_end[j]
                    np.logaddexp.at(a, (self.e[s], j, self.k[s] + 1), into[self.e[s], self.i[s], self.k[s] + 1] + score[s])
                into[:, j] = lse(a[:, j, :, None] + beside, axis=1)
            total = a[np.arange(m), self.n]
            whole = lse(total, axis=1)
            # z[j, y]: what follows position j where the last piece had the kind y
            ahead = np.full((m, most + 2, kinds), -np.inf)
            for i in range(most, -1, -1):
                nxt = np.full((m, kinds), -np.inf)
                if i < most:
                    nxt[:, 0] = z[:, i + 1, 0]
                s = self.by_start[i]
                np.logaddexp.at(nxt, (self.e[s], self.k[s] + 1), score[s] + z[self.e[s], self.j[s], self.k[s] + 1])
                ahead[:, i] = nxt
                z[:, i] = np.logaddexp(z[:, i], lse(beside + nxt[:, None, :], axis=2))
        p = np.exp(into[self.e, self.i, self.k + 1] + score + z[self.e, self.j, self.k + 1] - whole[self.e])
        gold = np.zeros(m)
        np.add.at(gold, self.e[self.gold], score[self.gold])
        step = self.gold - p
        per_key = np.bincount(self.key, step, len(self.features))
        g = np.zeros(BUCKETS + 1)
        np.add.at(g, self.features, per_key[:, None])
        # expected and gold neighbours
        pair = np.exp(a[:, :, :, None] + beside + ahead[:, : most + 1, None, :] - whole[:, None, None, None]).sum((0, 1))
        seen = np.zeros((kinds, kinds))
        chosen: dict[int, dict[int, tuple[int, int]]] = {}
        for s in np.flatnonzero(self.gold).tolist():
            chosen.setdefault(int(self.e[s]), {})[int(self.i[s])] = (int(self.j[s]), int(self.k[s]) + 1)
        for e in range(m):
            at, y, own = 0, 0, chosen.get(e, {})
            while at < self.n[e]:
                at, now = own.get(at, (at + 1, 0))
                seen[y, now] += 1
                y = now
        return float(gold.sum() + (seen * beside).sum() - whole.sum()), g[:BUCKETS], seen - pair


def window_of(raw: bytes, numbers: bool) -> Window | None:
    """The one window of a small text in which no span is taken."""
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    if numbers:
        g = Digits.of(data, offsets)
        found = list(number_windows(raw, data, offsets, g, np.zeros(len(g.start), bool)))
    else:
        found = list(address_windows(raw, offsets, [[]]))
    return found[0][1] if len(found) == 1 else None


def train(corpus: list[tuple[bytes, list[Span]]], words: list[bytes], made: int = MADE_WINDOWS, steps: int = STEPS, seed: int = 11) -> Model:
    """Weights from windows of the corpus and windows made by rule around the corpus's words."""
    rng = random.Random(seed)
    examples = [*corpus, *(_made(rng, words or [b"lorem", b"ipsum", b"dolor", b"sit"]) for _ in range(made))]
    sides: dict[bool, list] = {True: [], False: []}
    for raw, gold in examples:
        for numbers in (True, False):
            window = window_of(raw, numbers)
            own = {s for s in gold if (s[1] != EMAIL) == numbers}
            if window and window.candidates and window.n <= 32 and own <= {(c[4], c[2], c[5]) for c in window.candidates}:
                sides[numbers].append((window, own))
    batches = [Batch(e) for e in sides.values() if e]
    weights, beside = np.zeros(BUCKETS), np.zeros((len(KINDS) + 1,) * 2)
    total = sum(len(b.n) for b in batches)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(beside), np.zeros_like(beside)]
    for step in range(1, steps + 1):
        gw, gb = -1e-4 * weights, -1e-4 * beside
        for b in batches:
            _, w, t = b.gradient(weights, beside)
            gw, gb = gw + w / total, gb + t / total
        for x, g, first, second in ((weights, gw, *moments[:2]), (beside, gb, *moments[2:])):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            x += 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(weights, beside)


def _made(rng: random.Random, words: list[bytes]) -> tuple[bytes, list[Span]]:
    """A short text with some spans and their places, or with numbers that are none."""
    out = rng.choice(words) + rng.choice([b" ", b" ", b", ", b": ", b"\n", b" (", b"| "])
    if rng.random() < 0.15:
        out += rng.choice(list(CUES)).encode() + rng.choice([b" ", b": "])
    gold = []
    for at in range(rng.choice([1, 1, 1, 2, 2, 3])):
        if at:
            out += rng.choice([b" ", b" ", b" ", b"\n", b", ", b" / "])
        if rng.random() < 0.6:
            kind = rng.choice([EMAIL, IP, CARD, CARD, PHONE, PHONE])
            text = _WRITERS[kind](rng).encode()
            gold.append((len(out), kind, len(out) + len(text)))
            out += text
        else:
            out += _other(rng).encode()
    return out + rng.choice([b" ", b" ", b". ", b", ", b"!! ", b"\n", b" | ", b"*** "]) + rng.choice(words), gold


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1)) if n else ""


def _checked(rng: random.Random, n: int, right: bool) -> str:
    head = _number(rng, n - 1)
    good = next(d for d in "0123456789" if luhn((head + d).encode()))
    return head + (good if right else rng.choice([d for d in "0123456789" if d != good]))


def _email(rng: random.Random) -> str:
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    local = name() + rng.choice(["", "." + name(), "." + _number(rng, 2), _number(rng, 2)])
    host = [name() + rng.choice(["", _number(rng, 1)]), rng.choice(["com", "org", "net", "de", "fr", "es", "edu", "io"])]
    host = [name(), *host] if rng.random() < 0.3 else host
    at, dot = rng.choice([(" at ", " dot "), ("@", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), ("[at]", "."), (" @ ", "."), (" @ ", " . "), ("{at}", "{dot}"), (" AT ", " DOT ")])
    return local + at + dot.join(host)


def _ip(rng: random.Random) -> str:
    return rng.choice([".", ".", "[.]", " . ", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4))


def _card(rng: random.Random) -> str:
    n = rng.choice([16] * 8 + [15, 13, 19, 14])
    digits = _checked(rng, n, True)
    cut = rng.choice(["", "", "", " ", "-", ".", "/", "\n"])
    if not cut or n not in (15, 16, 19):
        return digits
    parts = [digits[:4], digits[4:10], digits[10:]] if n == 15 else [digits[i : i + 4] for i in range(0, n, 4)]
    return " ".join(parts[:2]) + "\n" + " ".join(parts[2:]) if cut == "\n" else cut.join(parts)


def _phone(rng: random.Random) -> str:
    c, a, b, d = str(rng.choice([1, 1, 33, 34, 44, 49])), _number(rng, 3), _number(rng, 3), _number(rng, 4)
    if rng.random() < 0.5:
        return rng.choice([f"+{c} ({a}) {b}-{d}"] * 3 + [f"+{c} {a} {b} {d}", f"+{c}-{a}-{b}-{d}", f"+{c}{a}{b}{d}", f"+{c} ({a})\n{b}-{d}", f"+{c} ({a}) {b}\n{d}"])
    return rng.choice([f"({a}) {b}-{d}", f"{a}-{b}-{d}", f"00{c} {a} {b}{d}", f"+{c}/{a}/{b}{d}", f"({a}) {b} {d}", f"00{c} {a} {b} {d}", f"{a}.{b}.{d}"])


def _other(rng: random.Random) -> str:
    r, n = rng.randint, lambda k: _number(rng, k)
    return rng.choice([
        lambda: f"{r(1900, 2030)}-{r(1, 12):02}-{r(1, 28):02}", lambda: f"{r(1, 28)}.{r(1, 12)}.{r(1900, 2030)}", lambda: f"{r(1, 28):02}/{r(1, 12):02}/{r(1900, 2030)} {r(0, 23):02}.{r(0, 59):02}",
        lambda: f"{r(1900, 2030)}-{r(1, 12):02}-{r(1, 28):02} {r(0, 23):02}-{r(0, 59):02}-{r(0, 59):02}", lambda: _checked(rng, r(13, 19), False), lambda: _checked(rng, 16, False), lambda: n(r(5, 12)), lambda: n(r(20, 24)),
        lambda: f"{n(r(1, 5))}.{n(r(1, 6))}", lambda: " ".join(n(r(1, 4)) for _ in range(r(3, 8))), lambda: f"{r(1900, 2030)}-{r(1900, 2030)}", lambda: ".".join(str(r(0, 20)) for _ in range(rng.choice([3, 5, 6]))),
        lambda: ".".join(str(r(256, 999)) for _ in range(4)), lambda: f"978-{r(0, 9)}-{n(2)}-{n(6)}-{r(0, 9)}", lambda: f"{n(3)} + {n(3)} - {n(4)}", lambda: f"{n(2)}-{n(3)}-{n(3)}", lambda: " ".join([n(4)] * 2), lambda: f"{n(8)}-{n(4)}",
        lambda: " ".join(_checked(rng, 16, False)[i : i + 4] for i in range(0, 16, 4)), lambda: "meet at noon the dot com boom", lambda: f"{n(1)} dot {n(1)} at home", lambda: "@ home and away . then", lambda: "look at the dot on it",
    ])()


_WRITERS = {EMAIL: _email, IP: _ip, CARD: _card, PHONE: _phone}


# --- operator ----------------------------------------------------------------------------------


def _windows_of_corpus(most: int):
    """Short texts around base spans and those spans, at most `most` a task: those of the least hash."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bytes, str]] = {}
        heap: list[int] = []
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in blocks(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                raw = part.tobytes()
                for row, spans in enumerate(base_spans(part, own)):
                    for start, _, _ in spans:
                        a, b = max(int(own[row]), start - 40), min(int(own[row + 1]), start + 60)
                        inside = [s for s in spans if s[0] >= a and s[2] <= b]
                        text = raw[a:b]
                        h = int.from_bytes(hashlib.blake2b(text, digest_size=7).digest(), "big")
                        if h in held or (len(heap) == most and h > -heap[0]):
                            continue
                        held[h] = (text, ",".join(f"{x - a}:{k}:{y - a}" for x, k, y in inside))
                        if len(heap) == most:
                            del held[-heapq.heappushpop(heap, -h)]
                        else:
                            heapq.heappush(heap, -h)
        rows = sorted(held.items())
        yield pa.record_batch([pa.array([h for h, _ in rows], pa.int64()), pa.array([t for _, (t, _) in rows], pa.binary()), pa.array([s for _, (_, s) in rows], pa.string())], ["h", "text", "spans"])

    return apply


def fit(docs: DataFrame, text: str = "text", windows: int = MOST_WINDOWS, made: int = MADE_WINDOWS) -> Model:
    """A model from at most `windows` windows of all documents and `made` ones by rule."""
    found = docs.select(text).mapInArrow(_windows_of_corpus(windows), "h long, text binary, spans string").dropDuplicates(["h"]).orderBy("h").limit(windows).collect()
    corpus, words = [], []
    for r in found:
        spans = [tuple(map(int, s.split(":"))) for s in r["spans"].split(",") if s]
        raw = bytes(r["text"])
        words += [w for w in re.findall(rb"[A-Za-z\x80-\xff]+", raw) if 1 < len(w) < 12][1:-1]
        # Long numbers that no span holds may be spans: such a window is no truth.
        if all(any(a <= m.start() < b for a, _, b in spans) for m in re.finditer(rb"[0-9][ ().0-9-]{6,}", raw)) and all(x[2] <= y[0] for x, y in zip(spans, spans[1:], strict=False)):
            corpus.append((raw, spans))
    return train(corpus, words, made)


def spans_of_block(data: np.ndarray, offsets: np.ndarray, model: Model) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base, added) spans of each text, in byte offsets of the block."""
    g, raw = Digits.of(data, offsets), data.tobytes()
    base = base_spans(data, offsets, g)
    added: list[list[Span]] = [[] for _ in base]
    for row, window in address_windows(raw, offsets, base):
        added[row] += model.best(window)
    marks = np.zeros(len(data) + 1, np.int32)
    for spans in (*base, *added):
        for start, _, end in spans:
            marks[start] += 1
            marks[end] -= 1
    held = np.cumsum(marks)
    taken = (held[g.start] > 0) | (held[g.end - 1] > 0) if len(g.start) else np.zeros(0, bool)
    for row, window in number_windows(raw, data, offsets, g, taken):
        # A sign before a number may belong to a base span; such a candidate is none.
        window.candidates = [c for c in window.candidates if not held[c[4]]]
        added[row] += model.best(window)
    yield from zip(base, map(sorted, added), strict=True)


def find(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and spans: array of (kind, start, end, base), code points, by start and kind; null texts have none."""
    if "spans" in keep:
        raise ValueError("a kept column may not be named spans")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.num_columns - 1))
            out = []
            for i, j in blocks(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                point = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int64)])
                for row, (base, added) in enumerate(spans_of_block(part, own, model)):
                    zero = point[own[row]]
                    every = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
                    out.append([{"kind": KINDS[k], "start": int(point[a] - zero), "end": int(point[b] - zero), "base": base_} for a, k, b, base_ in every])
            kept = [batch.column(c) for c in range(len(keep))]
            yield pa.record_batch([*kept, pa.array(out, item)], [*keep, "spans"])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(apply, ", ".join([*fields, "spans array<struct<kind:string,start:long,end:long,base:boolean>>"]))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """key, base spans by kind (n_email, n_ip, n_card, n_phone), base_sha256, spans."""
    slim = docs.select(docs[key].alias("__key"), docs[text].alias("__t"))
    found = find(slim, model or fit(slim, "__t"), "__key", text="__t")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("__key").alias(key), *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
