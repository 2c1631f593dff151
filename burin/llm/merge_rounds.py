"""SentencePiece encoding and decoding by vectorised merge rounds.

A text falls into words at spaces and line breaks. The distinct new words of a block lie as
one flat numpy array of symbols, cut into segments wherever two characters meet that stand
together in no piece. Each round takes the minimum pair rank by segment, merges the pairs of
that rank in all segments at once, from the left and without overlap, compacts the arrays,
and retires segments without a pair. Where a merge makes a new pair that ranks no later
than the round's own, only the leftmost merge of that segment counts, so the order is that of
one merge at a time (a long run of this kind, such as blanks, goes through a queue instead). A word's ids are kept, up to a bound, for the worker's next blocks.

Defined results: null and empty texts encode to the begin and end ids alone and decode
to an empty text. Repeated rows give the same digests. A begin id, an end id and a
literal U+2581 decode as the library does (nothing, nothing, a space).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burin.llm.common import blocks, text_buffers
from burin.llm.pieces import SPACE, PieceModel, load, resolve

#: Words whose ids a worker keeps before it starts afresh.
MOST_WORDS = 200_000
#: Merges that may wait for one before them, in runs of one character whose pieces rank out of order (blanks); beyond this the run is merged by a queue.
QUEUED = 64
_NEVER = np.int64(1) << np.int64(60)


class Encoder:
    def __init__(self, model: PieceModel):
        self.model = model
        keys, ranks, made = [], [], []
        for piece, pid in model.id.items():
            for k in range(1, len(piece)):
                a, b = model.id.get(piece[:k]), model.id.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * model.size + b)
                    ranks.append(model.rank[piece])
                    made.append(pid)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[order] for x in (keys, ranks, made))
        self.spans = np.array(sorted((ord(b[0]) << 21) | ord(b[1]) for b in model.bigrams), np.int64)
        self.single = {p: i for p, i in model.id.items() if len(p) == 1}
        apart = "" if any("\n" in b for b in model.bigrams) else "\n"
        self.words = re.compile(f" *[^ {apart}]+|{apart}+| +" if apart else " *[^ ]+| +")
        self.pool = [model.text.get(i, "").replace(SPACE, " ").encode() for i in range(model.size)]
        for b, i in enumerate(model.byte):
            self.pool[i] = bytes([b])
        self.pool_size = np.array([len(p) for p in self.pool])
        self.pool_at = np.concatenate([[0], np.cumsum(self.pool_size)])
        self.pool_bytes = np.frombuffer(b"".join(self.pool), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def ranked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or _NEVER, merged id) of pairs of symbols."""
        n = self.model.size
        key = np.where((a < n) & (b < n), a * n + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NEVER), self.made[at]

    def rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words, number by word); symbols from model.size on are code points."""
        size = self.model.size
        length = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(points):
            return points, length
        letters, inverse = np.unique(points, return_inverse=True)
        alphabet = np.array([self.single.get(chr(c), size + c) for c in letters.tolist()], np.int64)
        symbol, word, place, n = alphabet[inverse], np.repeat(np.arange(len(words)), length), np.arange(len(points)), len(letters)
        # Pairs of characters are looked up once for each two of the alphabet where that is the smaller table.
        if n * n <= len(points):
            pair, first, second = inverse[:-1] * n + inverse[1:], np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
        else:
            pair, first, second = place[:-1], inverse[:-1], inverse[1:]
        code = (letters[first] << 21) | letters[second]
        spanned = self.spans[np.minimum(np.searchsorted(self.spans, code), len(self.spans) - 1)] == code
        ranks, merged = self.ranked(alphabet[first], alphabet[second])
        inside = (word[:-1] == word[1:]) & spanned[pair]
        segment = np.concatenate([[0], np.cumsum(~inside)])
        rank, made = np.append(np.where(inside, ranks[pair], _NEVER), _NEVER), np.append(merged[pair], 0)
        done_symbol, done_place = [], []
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            sizes = np.diff(np.append(first, len(symbol)))
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            live = least < _NEVER
            if not live.all():
                done_symbol.append(symbol[~live])
                done_place.append(place[~live])
                symbol, segment, place, rank, made, least = (x[live] for x in (symbol, segment, place, rank, made, least))
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == least)
            run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            at, early = self.apart(at, symbol, segment, rank, made)
            if len(early):
                queued = np.isin(segment, early)
                for own in early.tolist():
                    mine = np.flatnonzero(segment == own)
                    text = [self.model.text.get(x) or chr(x - size) for x in symbol[mine].tolist()]
                    merged = [self.model.id.get(p, size + ord(p[0])) for p in self.model.merge(text)]
                    done_symbol.append(np.array(merged, np.int64))
                    done_place.append(place[mine[: len(merged)]])
                gone = np.cumsum(queued)
                at = at[~queued[at]]
                at = at - gone[at]
                symbol, segment, place, rank, made = (x[~queued] for x in (symbol, segment, place, rank, made))
                if not len(symbol):
                    break
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            symbol, segment, place, rank, made = (x[keep] for x in (symbol, segment, place, rank, made))
            near = np.concatenate([moved, np.maximum(moved - 1, 0)])
            rank[near], made[near] = self.next_to(symbol, segment, near)
        order = np.argsort(np.concatenate(done_place), kind="stable")
        return np.concatenate(done_symbol)[order], np.bincount(word[np.concatenate(done_place)], minlength=len(words))

    def next_to(self, symbol: np.ndarray, segment: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or _NEVER, merged id) of the symbols at these places and the ones after them."""
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, made = self.ranked(symbol[at], symbol[after])
        return np.where((after > at) & (segment[at] == segment[after]), rank, _NEVER), made

    def apart(self, at: np.ndarray, symbol: np.ndarray, segment: np.ndarray, rank: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places of a round's merges those that stand, whichever is merged first: all of a segment's, or its first.

        Second, the segments of which more than QUEUED merges would wait for their first.
        """
        own, n = segment[at], len(symbol)
        if (own[1:] != own[:-1]).all():
            return at, own[:0]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1)
        left = np.where(np.concatenate([[False], at[1:] == at[:-1] + 2]), np.concatenate([[0], made[at[:-1]]]), symbol[before])
        to_left = np.where((at > 0) & (segment[before] == own), self.ranked(left, made[at])[0], _NEVER)
        to_right = np.where((at + 2 < n) & (segment[after] == own), self.ranked(made[at], symbol[after])[0], _NEVER)
        bad = np.isin(own, own[np.minimum(to_left, to_right) <= rank[at]])
        first = np.concatenate([[True], own[1:] != own[:-1]])
        early, waits = np.unique(own[bad], return_counts=True)
        return at[first | ~bad], early[waits > QUEUED]

    def expanded(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary as byte ids."""
        size = self.model.size
        odd = np.flatnonzero(symbols >= size)
        if not len(odd):
            return symbols, sizes
        raw = [chr(c).encode("utf-8", "replace") for c in (symbols[odd] - size).tolist()]
        count = np.ones(len(symbols), np.int64)
        count[odd] = [len(r) for r in raw]
        out = np.repeat(symbols, count)
        at = np.repeat(np.isin(np.arange(len(symbols)), odd), count)
        out[at] = self.model.byte[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(count)[np.cumsum(sizes) - 1]
        return out, np.diff(np.concatenate([[0], ends]))

    def learn(self, names: list[str]) -> None:
        """Encode new words, spaces standing for U+2581, and file their ids."""
        symbols, sizes = self.expanded(*self.rounds([w.replace(" ", SPACE) for w in names]))
        base = len(self.known)
        self.known.update(zip(names, range(base, base + len(names)), strict=True))
        self.ids.append(symbols)
        self.sizes.append(sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids with begin and end of all texts, n + 1 offsets)."""
        if len(self.known) > MOST_WORDS:
            self.forget()
        split, words, counts = self.words.findall, [], []
        for t in texts:
            if t:
                own = split(" " + t.replace(SPACE, " "))
                words += own
                counts.append(len(own))
            else:
                counts.append(0)
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if new:
            self.learn(new)
        flat, sizes = np.concatenate(self.ids), np.concatenate(self.sizes)
        self.ids, self.sizes = [flat], [sizes]
        starts = np.cumsum(sizes) - sizes
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size = sizes[index]
        text_of = np.repeat(np.arange(len(texts)), counts)
        per_text = np.bincount(text_of, weights=size, minlength=len(texts)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(per_text + 2)])
        out = np.empty(offsets[-1], np.int64)
        out[offsets[:-1]], out[offsets[1:] - 1] = self.model.begin, self.model.end
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        body = np.ones(len(out), bool)
        body[offsets[:-1]] = body[offsets[1:] - 1] = False
        out[body] = flat[np.repeat(starts[index], size) + step]
        return out, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, n + 1 offsets); ids as encode() gives them.

        Pieces' bytes are gathered from one pool. The space before a text goes.
        """
        size = self.pool_size[ids]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out = self.pool_bytes[np.repeat(self.pool_at[ids], size) + step]
        at = np.concatenate([[0], np.cumsum(size)])[offsets]
        filled = at[1:] > at[:-1]
        lead = at[:-1][filled]
        first_id = ids[np.minimum(offsets[:-1] + 1, len(ids) - 1)][filled]
        spaced = (out[lead] == 32) & ~np.isin(first_id, self.model.byte)
        keep = np.ones(len(out), bool)
        keep[lead[spaced]] = False
        drop = np.zeros(len(filled), np.int64)
        drop[filled] = spaced
        return out[keep], at - np.concatenate([[0], np.cumsum(drop)])


_encoders: dict[str, Encoder] = {}


def encoder(model: str | None) -> Encoder:
    path = resolve(model)
    if path not in _encoders:
        _encoders[path] = Encoder(load(path))
    return _encoders[path]


def _digests(model: str | None):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            n, ids_hash, text_hash = [], [], []
            for i, j in blocks(offsets):
                raw = data[offsets[i] : offsets[j]].tobytes()
                own = offsets[i : j + 1] - offsets[i]
                ids, at = enc.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)])
                back, to = enc.decode(ids, at)
                narrow, back = memoryview(ids.astype("<u4")).cast("B"), memoryview(back)
                n += np.diff(at).tolist()
                ids_hash += [hashlib.sha256(narrow[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                text_hash += [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return apply


def encode_digests(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_digests(model), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with the column ids (array<int>) appended, every column kept but an older one of that name."""
    names = [c for c in docs.columns if c != "ids"]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "ids")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            data, offsets = text_buffers(column)
            for i, j in blocks(offsets):
                raw, own = data[offsets[i] : offsets[j]].tobytes(), (offsets[i : j + 1] - offsets[i]).tolist()
                ids, at = enc.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(own[:-1], own[1:], strict=True)])
                part = batch.slice(i, j - i)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in names), lists], [*names, "ids"])

    return docs.select(*[F.col(c) for c in names]).mapInArrow(apply, kinds + "ids array<int>")
