"""Token counts by a finite-state transducer compiled from the tokenizer.

BPE has two properties that make counting a finite-state matter: the encoding of a
prefix is the prefix's own encoding, and whether two tokens may stand side by side
depends on those two alone. So a state needs only the live part of the text (its
longest suffix that can still grow into a token) and, at each place where a token may
yet begin, the token that ends there and the count up to there, relative to now. A
transition reads one character and is annotated with the change of the token count,
which is negative when characters join. States are finite, compiled when first
reached, kept for the worker's life in a hash table, and dropped when too many.

Texts are cut into chunks. A chunk that holds a synchronising place, one that no piece
spans, maps every entry state to the same exit state: its tail runs at once, all chunks
in lockstep. A chunk without such a place has a map of the entry states it may meet, found
for all such chunks side by side, and a prefix scan composes the maps (see scan()), its
reach doubling in each step. Last, the heads run from their entry states. Long texts go
section by section, each from the state that the one before it ended in.

Defined results: null and empty texts have 0 bytes and 0 tokens. Repeated rows count
alike. Only the id and the text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burin.llm.common import blocks, text_buffers
from burin.llm.pieces import SPACE, PieceModel, code_points, load, resolve

CHUNK = 256
#: Symbols before a chunk that its first entry state is guessed from, and rounds in which maps grow side by side,
#: and chunks ahead that take in a state that was missing, at most.
WARM, MOST_ROUNDS, MOST_AHEAD = 64, 32, 4096
LIMIT = 4096
#: Transitions kept by a worker from one section to the next; beyond this it starts afresh.
MOST_TRANSITIONS = 1 << 20
#: Symbols that are scanned together. The state at the end of a section is all that the next one needs, so a text
#: of any length meets at most a section's new transitions before they can be dropped.
SECTION = 1 << 20
#: Bits of the first table's slots (50 MB); it doubles before it is half full.
_BITS = 22
#: A place with at most so many tokens to come is known by the set of them.
MOST_FOLLOWERS = 64
_HASH = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """States are numbers; state 0 is the start, where nothing before matters."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.points = np.full(0x110000, -1, np.int32)
        #: Symbols 0 to 3 stand for characters outside the vocabulary, of 1 to 4 bytes.
        self.letters: list[str] = ["\0"] * 4
        letters = sorted({c for p in model.id for c in p})
        for c in letters:
            if c in model.id:
                self.points[ord(c)] = len(self.letters)
                self.letters.append(c)
        self.points[32] = self.points[ord(SPACE)]
        self.space = int(self.points[32])
        everything = np.arange(0x110000)
        self.starting: dict[str, list[str]] = {}
        for p in model.id:
            if len(p) > 1 and model.whole(p):
                for k in range(1, len(p)):
                    self.starting.setdefault(p[:k], []).append(p)
        strange = self.points < 0
        self.points[strange] = ((everything >= 0x80).astype(int) + (everything >= 0x800) + (everything >= 0x10000))[strange]
        self.sets: list[frozenset[str]] = []
        self.set_number: dict[frozenset[str], int] = {}
        self.narrow: dict[tuple[str | int, str], str | int | None] = {}
        self.forget()

    def forget(self, kept: int = 0) -> int:
        """Drop states and transitions, but for one state; returns its new number."""
        start = ("", ((0, "", 0),))
        own = self.state[kept] if kept else start
        self.number, self.state = {start: 0}, [start]
        if own != start:
            self.number[own] = 1
            self.state.append(own)
        else:
            self.sets, self.set_number, self.narrow = [], {}, {}
        self.hold(_BITS)
        self.transitions = 0
        return len(self.state) - 1

    def hold(self, bits: int) -> None:
        """Empty slots, 2 ** bits of them."""
        self.bits = bits
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_to = np.zeros(1 << bits, np.int32)
        self.slot_add = np.zeros(1 << bits, np.int8)

    def slot_of(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def reserve(self, more: int) -> None:
        """Double the slots until they stay half empty with so many more transitions."""
        bits = self.bits
        while 2 * (self.transitions + more) > 1 << bits:
            bits += 1
        if bits == self.bits:
            return
        some = np.flatnonzero(self.slot_key >= 0)
        key, to, add = self.slot_key[some], self.slot_to[some], self.slot_add[some]
        self.hold(bits)
        left, slot = np.arange(len(key)), self.slot_of(key)
        while len(left):
            free = left[self.slot_key[slot[left]] < 0]
            self.slot_key[slot[free]] = key[free]  # of several for a slot one stays
            own = left[self.slot_key[slot[left]] == key[left]]
            self.slot_to[slot[own]], self.slot_add[slot[own]] = to[own], add[own]
            left = left[self.slot_key[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & ((1 << bits) - 1)

    def narrowed(self, value: str | int, begun: str) -> str | int | None:
        """What must be known of a place from which a token that starts with `begun` may yet come.

        The token that ends there, or, once few tokens start with `begun`, the number of
        the set of those that may follow it; places with equal sets are alike. None if no
        token may follow.
        """
        found = self.narrow.get((value, begun), "?")
        if found != "?":
            return found
        if isinstance(value, int):
            left = frozenset(t for t in self.sets[value] if len(t) > len(begun) and t.startswith(begun))
        else:
            more = self.starting.get(begun, ())
            if len(more) > MOST_FOLLOWERS:
                left = None
            else:
                model = self.model
                left = frozenset(t for t in more if not value or model.stand_together(value, t))
        if left is None:
            found = value
        elif not left:
            found = None
        else:
            found = self.set_number.setdefault(left, len(self.sets))
            if found == len(self.sets):
                self.sets.append(left)
        self.narrow[value, begun] = found
        return found

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the count) on reading a symbol.

        A state is (live suffix, ((reach back, what is known of that place, count there less count now), ...)).
        """
        if symbol < 4:
            return 0, symbol + 1
        model, c = self.model, self.letters[symbol]
        live, places = self.state[state]
        grown = live + c
        token, add = c, 1
        for back, value, count in places:
            t = grown[len(live) - back :]
            if t in self.sets[value] if isinstance(value, int) else model.stands(t) and (not value or model.stand_together(value, t)):
                token, add = t, count + 1
                break
        kept = []
        for back, value, count in places:
            t = grown[len(live) - back :]
            if t in model.prefixes and (narrow := self.narrowed(value, t)) is not None:
                kept.append((back + 1, narrow, count - add))
        if c in model.first_of_bigram:
            kept.append((0, token, 0))
        else:
            kept.append((0, "", 0))
        reach = kept[0][0]
        key = (grown[len(grown) - reach :], tuple(kept))
        number = self.number.setdefault(key, len(self.state))
        if number == len(self.state):
            self.state.append(key)
        return number, add

    def find(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, change) of many transitions, compiling those not met before."""
        key = (state.astype(np.int64) << 20) | symbol
        self.reserve(len(key))
        slot = self.slot_of(key)
        wrong = np.flatnonzero(self.slot_key[slot] != key)
        while len(wrong):
            empty = self.slot_key[slot[wrong]] < 0
            if empty.any():
                new = np.unique(key[wrong[empty]])
                for k in new.tolist():
                    self.file(k, *self.compile(k >> 20, k & 0xFFFFF))
            wrong = wrong[self.slot_key[slot[wrong]] != key[wrong]]
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            wrong = wrong[self.slot_key[slot[wrong]] != key[wrong]]
        return self.slot_to[slot], self.slot_add[slot]

    def file(self, key: int, to: int, add: int) -> None:
        at = ((key * int(_HASH)) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.slot_key[at] >= 0:
            at = (at + 1) & ((1 << self.bits) - 1)
        self.slot_key[at], self.slot_to[at], self.slot_add[at] = key, to, add
        self.transitions += 1

    def run(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, count) of each lane [start, end) from its entry state, in lockstep."""
        order = np.argsort(start - end, kind="stable")
        at, length, now = start[order], (end - start)[order], state[order].astype(np.int32)
        total = np.zeros(len(order), np.int64)
        lanes = len(order)
        longest = int(length[0]) if lanes else 0
        alive = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
        for step in range(longest):
            m = int(alive[step])
            to, add = self.find(now[:m], symbols[at[:m] + step])
            now[:m] = to
            total[:m] += add
        back = np.empty(lanes, np.int64)
        back[order] = np.arange(lanes)
        return now[back], total[back]

    def scan(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, synced: np.ndarray, exit_state: np.ndarray, total: np.ndarray) -> None:
        """Exit states and counts of the chunks without a synchronising place, from their state maps.

        A chunk's map is a list of nodes, entry state to (exit state, count). It starts from the
        known exit of a synchronised chunk before it, or from a guess made over the WARM symbols
        before it; then every map takes in what the map before it may hand over, all chunks at
        once, until nothing is missing or MOST_ROUNDS have passed. A prefix scan composes the
        maps: pointers from node to node double their reach in each step, and mark the nodes
        that the known states come to. Where a marked node's exit is not in the next map, it goes
        into the maps of the chunks ahead, of twice as many each time: in text that repeats, what
        one chunk meets the next ones meet too.
        """
        own = np.flatnonzero(~synced)
        if not len(own):
            return
        led = synced[own - 1]
        entry = exit_state[own - 1].astype(np.int64)
        guess = own[~led]
        entry[~led] = self.run(symbols, start[guess] - WARM, start[guess], np.zeros(len(guess), np.int32))[0]
        following = np.append(~synced[1:], False)

        def nodes(key: np.ndarray) -> tuple[np.ndarray, ...]:
            chunk, state = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
            to, count = self.run(symbols, start[chunk], end[chunk], state)
            return key, np.where(following[chunk], ((chunk + 1) << 32) | to, -1), to, count

        def joined(a: tuple, b: tuple) -> tuple:
            order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
            return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

        def missing(table: tuple, wanted: np.ndarray) -> np.ndarray:
            wanted = np.unique(wanted[wanted >= 0])
            at = np.minimum(np.searchsorted(table[0], wanted), len(table[0]) - 1)
            return wanted[table[0][at] != wanted]

        table = nodes((own << 32) | entry)
        first = (own[led] << 32) | entry[led]
        ends_at = np.append(np.flatnonzero(~following), len(start))
        ahead = 1
        while True:
            for _ in range(MOST_ROUNDS):
                new = missing(table, table[1])
                if not len(new):
                    break
                table = joined(table, nodes(new))
            n = len(table[0])
            at = np.minimum(np.searchsorted(table[0], table[1]), n - 1)
            jump = np.append(np.where(table[0][at] == table[1], at, n), n)
            marked = np.zeros(n + 1, bool)
            marked[np.searchsorted(table[0], first)] = True
            for _ in range(int(n).bit_length()):
                marked[jump[marked]] = True
                jump = jump[jump]
            reached = np.flatnonzero(marked[:n])
            new = missing(table, table[1][reached])
            if not len(new):
                break
            ahead = min(2 * ahead, MOST_AHEAD)
            chunk = new >> 32
            many = np.minimum(ahead, ends_at[np.searchsorted(ends_at, chunk)] - chunk + 1)
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            table = joined(table, nodes(missing(table, np.repeat(new, many) + (step << 32))))
        chunk = table[0][reached] >> 32
        exit_state[chunk], total[chunk] = table[2][reached], table[3][reached]

    def count(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a block; offsets in code points."""
        n = len(offsets) - 1
        length = np.diff(offsets)
        some = length > 0
        # Each text that is not empty begins with a space of the tokenizer's own.
        symbols = np.empty(len(points) + int(some.sum()), np.int32)
        lead = offsets[:-1][some] + np.arange(int(some.sum()))
        body = np.ones(len(symbols), bool)
        body[lead] = False
        symbols[lead], symbols[body] = self.space, self.points[points]
        first = np.zeros(n, np.int64)
        first[some] = lead
        length = length + some
        chunks = -(-length // CHUNK)
        text = np.repeat(np.arange(n), chunks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = first[text] + nth * CHUNK
        end = np.minimum(start + CHUNK, first[text] + length[text])
        if not len(start):
            return np.zeros(n, np.int64)
        # A space after another character, or after a character outside the vocabulary, forgets what was before.
        forgets = np.zeros(len(symbols) + 1, bool)
        forgets[1:-1] = ((symbols[1:] == self.space) & (symbols[:-1] != self.space)) | (symbols[:-1] < 4)
        forgets[lead] = True
        places = np.flatnonzero(forgets)
        sync = np.append(places, len(symbols))[np.searchsorted(places, start)]
        synced = sync < end
        cut = np.where(synced, sync, end)
        total = np.zeros(len(start), np.int64)
        carried = 0
        for a in range(0, len(start), SECTION // CHUNK):
            b = min(len(start), a + SECTION // CHUNK)
            if self.transitions > MOST_TRANSITIONS:
                carried = self.forget(carried)
            carried = self.section(symbols, start[a:b], end[a:b], synced[a:b], cut[a:b], carried, total[a:b])
        return np.bincount(text, weights=total, minlength=n).astype(np.int64)

    def section(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, synced: np.ndarray, cut: np.ndarray, carried: int, total: np.ndarray) -> int:
        """Fill total with the counts of chunks that follow the state `carried`; returns the state after them."""
        # A chunk without symbols stands for what was before.
        lead = lambda x, value: np.concatenate([np.array([value], x.dtype), x])
        start, end, synced, cut = lead(start, start[0]), lead(end, start[0]), lead(synced, True), lead(cut, start[0])
        exit_state, own = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64)
        exit_state[synced], own[synced] = self.run(symbols, cut[synced], end[synced], np.zeros(int(synced.sum()), np.int32))
        exit_state[0] = carried
        self.scan(symbols, start, end, synced, exit_state, own)
        heads = np.flatnonzero(synced & (cut > start))
        own[heads] += self.run(symbols, start[heads], cut[heads], exit_state[heads - 1])[1]
        total[:] = own[1:]
        return int(exit_state[-1])


_compiled: dict[str, Transducer] = {}


def transducer(model: str | None) -> Transducer:
    path = resolve(model)
    if path not in _compiled:
        _compiled[path] = Transducer(load(path))
    return _compiled[path]


def _counts(model: str | None, limit: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            size = np.diff(offsets)
            tokens = np.zeros(len(size), np.int64)
            for i, j in blocks(offsets):
                tokens[i:j] = machine.count(*code_points(batch.column(1), i, j, offsets, data))
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return apply


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs."""
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_counts(model, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
