"""Benchmark decontamination by Wu-Manber search over words.

A benchmark item gives windows of WINDOW consecutive words (one shorter window if it
has fewer). Windows of one length are searched together, Wu and Manber's way, with
words as the alphabet: the shift table says for each block of two words how far the
end of a window may be moved, a block that ends a window leads to the bucket of the
windows with that suffix hash, and bucket members are compared word by word, then byte
by byte. Many places of a batch of texts are searched in lockstep.

The windows of one pass are bounded (PASS_WORDS); a larger benchmark is searched in
several passes, each starting from what the pass before has found, so nothing is sent
that grows beyond the bound.

Defined results: a null text has no words; an item without words, or null, has no
window; repeated items with the same id count once, items with a null id are not
reported but mark their words; each row of docs, repeated or not, gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burin.llm.common import FOLD, blocks, persisted, scramble, text_buffers, words

WINDOW = 10
#: Words of benchmark windows searched in one pass (some 40 MB of tables).
PASS_WORDS = 1_000_000
#: Candidates (a place and a window of its bucket) that are compared at once, about.
CANDIDATES = 2_000_000
#: Places searched by one lane.
LANE = 512


def _block_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return scramble(a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C159E3779B9)))


@dataclass
class Patterns:
    """Distinct windows of one length.

    symbols (n, length): word hashes, rows sorted by suffix; shift: by block slot;
    suffix, first: sorted suffix hashes and where their bucket begins; items: the items
    of each window, as numbers.
    """

    length: int
    symbols: np.ndarray
    texts: list[bytes]
    items: list[np.ndarray]
    shift: np.ndarray
    suffix: np.ndarray

    @property
    def block(self) -> int:
        return min(2, self.length)


def _slots(shift: np.ndarray) -> np.uint64:
    return np.uint64(len(shift) - 1)


def _suffix(symbols: np.ndarray, end: np.ndarray, block: int) -> np.ndarray:
    return _block_hash(symbols[end - 2], symbols[end - 1]) if block == 2 else scramble(symbols[end - 1])


def compile_patterns(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Tables for the windows of (item number, text) pairs, by length of window."""
    by: dict[int, dict[bytes, set[int]]] = {}
    hashes: dict[bytes, np.ndarray] = {}
    for number, text in items:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        start, end, key, _ = words(raw, np.array([0, len(raw)]))
        if not len(start):
            continue
        low = FOLD[raw].tobytes()
        length = min(window, len(start))
        for k in range(len(start) - length + 1):
            canon = b" ".join(low[a:b] for a, b in zip(start[k : k + length].tolist(), end[k : k + length].tolist(), strict=True))
            by.setdefault(length, {}).setdefault(canon, set()).add(number)
            hashes[canon] = key[k : k + length]
    out = []
    for length, found in sorted(by.items()):
        block = min(2, length)
        texts = list(found)
        symbols = np.stack([hashes[t] for t in texts])
        suffix = _suffix(symbols.ravel(), np.arange(1, len(texts) + 1) * length, block)
        order = np.argsort(suffix, kind="stable")
        symbols, suffix = symbols[order], suffix[order]
        shift = np.full(1 << max(12, int(8 * symbols.size).bit_length()), length - block + 1, np.int16)
        for k in range(block, length + 1):
            at = _suffix(symbols.ravel(), np.arange(len(texts)) * length + k, block) & _slots(shift)
            np.minimum.at(shift, at.astype(np.int64), length - k)
        out.append(Patterns(length, symbols, [texts[i] for i in order], [np.array(sorted(found[texts[i]])) for i in order], shift, suffix))
    return out


def occurrences(p: Patterns, symbols: np.ndarray, text_end: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end place, window) of every occurrence among the words of a block of texts.

    text_end: one past the last word of each text. A place is the end of a possible window.
    """
    m, b = p.length, p.block
    none = np.zeros(0, np.int64)
    begin = np.concatenate([[0], text_end[:-1]])
    places = np.maximum(text_end - begin - m + 1, 0)
    lanes = -(-places // LANE)
    text = np.repeat(np.arange(len(text_end)), lanes)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = begin[text] + m + nth * LANE
    last = np.minimum(at + LANE, text_end[text] + 1)
    slot = (_block_hash(symbols[:-1], symbols[1:]) if b == 2 else scramble(symbols)) & _slots(p.shift) if len(symbols) >= b else np.zeros(0, np.uint64)
    # The shift of the block that ends before each place; looked up once, read as the lanes come by.
    jump = np.zeros(len(symbols) + 1, np.int16)
    jump[b:] = p.shift[slot.astype(np.int64)]
    ends = []
    while len(at):
        step = jump[at]
        hit = step == 0
        if hit.any():
            ends.append(at[hit])
        at = at + np.maximum(step, 1)
        alive = at < last
        at, last = at[alive], last[alive]
    if not ends:
        return none, none
    end = np.concatenate(ends)
    key = _suffix(symbols, end, b)
    lo, hi = np.searchsorted(p.suffix, key), np.searchsorted(p.suffix, key, side="right")
    # A bucket may hold many windows and its suffix stand at many places: candidates go in slices.
    n = hi - lo
    cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + 1, CANDIDATES), side="right")
    cuts = np.unique(np.concatenate([[0], cuts, [len(n)]]))
    found = [(none, none)]
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = n[i:j]
        place = np.repeat(end[i:j], own)
        window = np.repeat(lo[i:j], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        # Compare the first word of all candidates, then the rest of those that are left.
        for k in range(m):
            same = symbols[place - m + k] == p.symbols[window, k]
            place, window = place[same], window[same]
        found.append((place, window))
    place, window = (np.concatenate(x) for x in zip(*found, strict=True))
    return place, window


def _confirmed(p: Patterns, place: np.ndarray, window: np.ndarray, low: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which occurrences have the very bytes of their window."""
    good = np.ones(len(place), bool)
    seen: dict[tuple[bytes, int], bool] = {}
    a, b = start[place - p.length].tolist(), stop[place - 1].tolist()
    for k, w in enumerate(window.tolist()):
        key = (low[a[k] : b[k]], w)
        if key not in seen:
            i = int(place[k])
            seen[key] = b" ".join(low[x:y] for x, y in zip(start[i - p.length : i].tolist(), stop[i - p.length : i].tolist(), strict=True)) == p.texts[w]
        good[k] = seen[key]
    return good


def scan(patterns: list[Patterns], data: np.ndarray, offsets: np.ndarray):
    """(words by text, hit words as (text, place) pairs, (text, item) pairs) of a block."""
    n = len(offsets) - 1
    start, stop, symbols, row = words(data, offsets)
    count = np.bincount(row, minlength=n)
    ends = np.cumsum(count)
    low = FOLD[data].tobytes()
    begun, ended = np.zeros(len(symbols) + 1, np.int32), np.zeros(len(symbols) + 1, np.int32)
    pairs = [np.zeros((0, 2), np.int64)]
    for p in patterns:
        place, window = occurrences(p, symbols, ends, row)
        if not len(place):
            continue
        good = _confirmed(p, place, window, low, start, stop)
        place, window = place[good], window[good]
        if not len(place):
            continue
        np.add.at(begun, place - p.length, 1)
        np.add.at(ended, place, 1)
        both = np.unique(np.stack([row[place - 1], window], 1), axis=0)
        per = np.array([len(p.items[w]) for w in both[:, 1].tolist()])
        pairs.append(np.stack([np.repeat(both[:, 0], per), np.concatenate([p.items[w] for w in both[:, 1].tolist()])], 1))
    hit = np.cumsum(begun - ended)[:-1] > 0
    return count, hit, row, np.unique(np.concatenate(pairs), axis=0)


def _passes(items: DataFrame, key: str, text: str, bound: int) -> list[DataFrame]:
    """The benchmark in parts of about `bound` words of windows at most."""
    slim = items.select(F.col(key).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    # A window starts at each word, and a word is preceded by a separator: at most WINDOW times half the bytes.
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size * WINDOW // (2 * bound)))
    if parts == 1:
        return [slim]
    return [slim.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) for k in range(parts)]


def _found(patterns: list[Patterns], names: list[str | None], column: pa.Array):
    """(words, packed hit words, items) of each text of a batch."""
    data, offsets = text_buffers(column)
    n_words, hits, items = [], [], []
    for i, j in blocks(offsets):
        count, hit, row, pairs = scan(patterns, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n_words += count.tolist()
        at = np.concatenate([[0], np.cumsum(count)]).tolist()
        split = np.searchsorted(pairs[:, 0], np.arange(j - i + 1)).tolist()
        whole = np.concatenate([[0], np.cumsum(hit)])
        touched = (whole[at[1:]] > whole[at[:-1]]).tolist()
        for k in range(j - i):
            hits.append(np.packbits(hit[at[k] : at[k + 1]]).tobytes() if touched[k] else b"")
            items.append([names[x] for x in pairs[split[k] : split[k + 1], 1].tolist() if names[x] is not None] if touched[k] else [])
    return n_words, hits, items


def _either(a: bytes, b: bytes) -> bytes:
    if not a or not b:
        return a or b
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


def _scan_pass(sent, first: bool, last: bool):
    """Columns in: doc_id, text and, after the first pass, hits and items so far."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, names = sent.value
        for batch in batches:
            n_words, hits, items = _found(patterns, names, batch.column(1))
            if not first:
                hits = [_either(a, b) for a, b in zip(hits, batch.column(2).to_pylist(), strict=True)]
                items = [a + b for a, b in zip(items, batch.column(3).to_pylist(), strict=True)]
            if not last:
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "hits", "items"])
                continue
            n_hit = [int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in hits]
            items = [sorted(set(x)) for x in items]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in n_hit], pa.bool_()), pa.array(items, pa.list_(pa.string())), pa.array(hits, pa.binary())]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits"])

    return apply


def _tables(part: DataFrame):
    rows = part.dropDuplicates().collect()  # a part has at most `bound` words of windows
    names = [*sorted({r["item"] for r in rows if r["item"] is not None}), None]
    number = {name: i for i, name in enumerate(names)}
    return part.sparkSession.sparkContext.broadcast((compile_patterns([(number[r["item"]], r["text"]) for r in rows]), names))


def report(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", bound: int = PASS_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, hits (a bit for each word) of every row of docs."""
    out = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = out.schema["doc_id"].dataType.simpleString()
    parts = _passes(items, item, item_text, bound)
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        names = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hits binary" if last else "text string, hits binary, items array<string>"
        out = out.mapInArrow(_scan_pass(_tables(part), not k, last), f"doc_id {kind}, {names}")
        out = out if last else persisted(out)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", bound: int = PASS_WORDS) -> DataFrame:
    """The rows of docs without any occurrence of a benchmark window, all columns kept."""
    for part in _passes(items, item, item_text, bound):
        sent = _tables(part)

        def apply(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            patterns, names = sent.value
            for batch in batches:
                _, hits, _ = _found(patterns, names, batch.column(batch.schema.get_field_index(text)))
                yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

        docs = docs.mapInArrow(apply, docs.schema)
    return docs


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item, n, array_to_string(w[s + 1 : s + n], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT rid, n, s, array_to_string(w[s + 1 : s + n], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d, sizes)),
m AS (SELECT dw.rid, dw.s, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m WHERE item IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
