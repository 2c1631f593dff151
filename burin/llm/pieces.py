"""A SentencePiece BPE vocabulary, read through the library and kept per process.

Encoding rules used here: identity normaliser, a space before the text, spaces as
U+2581, merges by (score, leftmost), characters outside the vocabulary as bytes.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa

from burin.llm.common import text_buffers

SPACE = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"


def resolve(model: str | None) -> str:
    """The path of a model: a path itself, or the default model of the installed vocabularies."""
    if model:
        return model
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.begin, self.end, self.unknown = n, sp.bos_id(), sp.eos_id(), sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.text = {i: p for p, i in self.id.items()}
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        #: Rank by score, equal scores alike: lower merges earlier.
        self.rank = {p: order[sp.get_score(i)] for p, i in self.id.items()}
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[1:-1], 16)] = i
        self.longest = max(map(len, self.id))
        inner = [p for p in self.id if len(p) > 1]
        self.bigrams = {p[k : k + 2] for p in inner for k in range(len(p) - 1)}
        self.prefixes = {p[:k] for p in inner for k in range(1, len(p))}
        self.first_of_bigram = {b[0] for b in self.bigrams}
        if any(b[1] == SPACE and b[0] != SPACE for b in self.bigrams):
            raise ValueError("pieces of this model hold a space after a letter; words would not be independent")
        #: Pieces by their last merge; filled by whole().
        self._self: dict[str, bool] = {}
        self._parts: dict[str, tuple[str, str]] = {}
        #: Pieces with a part, or a part's part, that ranks behind them.
        self._odd: set[str] = set()
        self._spine: dict[tuple[str, bool], list[tuple[str, int]]] = {}
        self._pair: dict[tuple[str, str], bool] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge a list of symbols by (rank, leftmost), with a queue."""
        n = len(symbols)
        text, left, right = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank
        queue = [(rank[p], i, p) for i in range(n - 1) if (p := text[i] + text[i + 1]) in rank]
        heapq.heapify(queue)
        while queue:
            _, i, p = heapq.heappop(queue)
            j = right[i] if text[i] is not None else n
            if j >= n or text[i] + text[j] != p:
                continue
            self.last = text[i], text[j]
            text[i], text[j], right[i] = p, None, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (q := p + text[right[i]]) in rank:
                    heapq.heappush(queue, (rank[q], i, q))
            if left[i] >= 0 and (q := text[left[i]] + p) in rank:
                heapq.heappush(queue, (rank[q], left[i], q))
        return [t for t in text if t is not None]

    def whole(self, piece: str) -> bool:
        """True if encoding this piece's own text gives the piece."""
        if piece not in self._self:
            self._self[piece] = self.merge(list(piece)) == [piece]
            if self._self[piece] and len(piece) > 1:
                self._parts[piece] = parts = self.last
                if any(len(x) > 1 and (self.rank[x] >= self.rank[piece] or self.whole(x) and x in self._odd) for x in parts):
                    self._odd.add(piece)
        return self._self[piece]

    def spine(self, piece: str, right: bool) -> list[tuple[str, int]]:
        """What stands at one edge of a whole piece as its merges go on, first the single character, each with the rank of the merge that ends it."""
        found = self._spine.get((piece, right))
        if found is None:
            found, p, ends = [], piece, 1 << 60
            while True:
                found.append((p, ends))
                if len(p) == 1:
                    break
                self.whole(p)
                p, ends = self._parts[p][right], self.rank[p]
            found.reverse()
            self._spine[piece, right] = found
        return found

    def stands(self, text: str) -> bool:
        return text in self.id and self.whole(text)

    def stand_together(self, a: str, b: str) -> bool:
        """True if whole pieces a then b are how their joined text is encoded.

        Merges go by rank, so both sides' edges grow in the order of their merges' ranks; the
        pieces stay apart unless two edges that meet make a piece that merges before either
        of them goes on (a tie goes to the left side). Where ranks do not rise from part to
        piece, the merges are made.
        """
        if a[-1] + b[0] not in self.bigrams:
            return True
        found = self._pair.get((a, b))
        if found is None:
            if len(self._pair) > 200_000:
                self._pair.clear()
            if not (self.whole(a) and self.whole(b)) or a in self._odd or b in self._odd:
                found = self._pair[a, b] = self.merge(list(a + b)) == [a, b]
                return found
            rank, left, right, i, j = self.rank, self.spine(a, True), self.spine(b, False), 0, 0
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                joined = rank.get(x + y)
                if joined is not None and joined < x_ends and joined <= y_ends:
                    found = False
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
                if i == len(left) or j == len(right):
                    found = True
                    break
            self._pair[a, b] = found
        return found


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def code_points(column: pa.Array, i: int, j: int, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of texts i to j of a batch."""
    raw = data[offsets[i] : offsets[j]]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, starts[offsets[i : j + 1] - offsets[i]]


__all__ = ["SPACE", "PieceModel", "code_points", "load", "resolve", "text_buffers"]
