"""A fixed public piece vocabulary, and the segmentations of words into its pieces."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from veil.llm import common as C

SPACE = "▁"                     # stands for the blank before a word (fixed value)
_CHAR_BITS = 21


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … (counts[0] of them), then the same of the next."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, in the order of its ids."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_proto=C.bounded_file(path))
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def rank_log_probs(n_pieces: int) -> tuple[np.ndarray, float]:
    """Log probabilities in proportion to 1 / (1 + place), and that of one byte outside the pieces."""
    weight = 1.0 / np.arange(1, n_pieces + 2)
    log = np.log(weight / weight.sum())
    return log[:-1], float(log[-1])


class PieceTrie(NamedTuple):
    """All pieces as a trie: sorted edges, and the piece that ends at a state."""

    keys: np.ndarray            # state << 21 | code point
    targets: np.ndarray
    piece: np.ndarray           # per state; -1 where no piece ends

    @classmethod
    def of(cls, pieces: list[str]) -> PieceTrie:
        edges: dict[int, int] = {}
        ends = {}
        for k, p in enumerate(pieces):
            state = 0
            for ch in p:
                state = edges.setdefault(state << _CHAR_BITS | ord(ch), len(edges) + 1)
            ends[state] = k
        piece = np.full(len(edges) + 1, -1, dtype=np.int64)
        piece[list(ends)] = list(ends.values())
        keys = np.array(sorted(edges), dtype=np.int64)
        return cls(keys, np.array([edges[k] for k in keys.tolist()], dtype=np.int64), piece)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states, -1 where no piece goes on."""
        if not len(self.keys):
            return np.full(len(state), -1, dtype=np.int64)
        key = state << _CHAR_BITS | code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], -1)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words in a row, and the length of each word."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return flat, np.fromiter(map(len, words), np.int64, len(words))


def utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64)


class Lattice(NamedTuple):
    """All piece occurrences in the words, as edges between places.

    Word w has len + 1 places from ``first[w]`` on.  A character that is no
    piece by itself has one more edge, with piece -1 and ``cost`` bytes.
    """

    first: np.ndarray
    lens: np.ndarray
    start: np.ndarray           # place
    end: np.ndarray             # place
    piece: np.ndarray
    cost: np.ndarray
    order: np.ndarray           # of the edges by (characters before their end, end)
    steps: np.ndarray           # bounds of the edges of each such number

    @classmethod
    def of(cls, words: list[str], trie: PieceTrie) -> Lattice:
        flat, lens = code_points(words)
        first = np.cumsum(lens + 1) - (lens + 1)
        word = np.repeat(np.arange(len(words)), lens)
        depth = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        place = first[word] + depth
        left = lens[word] - depth                   # characters from here to the word's end
        at, state = np.arange(len(flat)), np.zeros(len(flat), dtype=np.int64)
        start, end, piece = [], [], []
        step = 0
        alone = np.zeros(len(flat), dtype=bool)
        while len(at):
            state = trie.step(state, flat[at + step])
            go = state >= 0
            at, state = at[go], state[go]
            step += 1
            found = trie.piece[state]
            hit = found >= 0
            if step == 1:
                alone[at[hit]] = True
            start.append(place[at[hit]])
            end.append(place[at[hit]] + step)
            piece.append(found[hit])
            go = left[at] > step
            at, state = at[go], state[go]
        rest = np.flatnonzero(~alone)
        start, end = np.concatenate([*start, place[rest]]), np.concatenate([*end, place[rest] + 1])
        piece = np.concatenate([*piece, np.full(len(rest), -1, dtype=np.int64)])
        cost = np.zeros(len(piece), dtype=np.int64)
        cost[len(piece) - len(rest):] = utf8_size(flat[rest])
        places = int((lens + 1).sum())
        of_place = np.zeros(places, dtype=np.int64)
        of_place[place + 1] = depth + 1
        order = np.lexsort((end, of_place[end]))
        steps = np.searchsorted(of_place[end][order], np.arange(1, int(lens.max(initial=0)) + 2))
        return cls(first, lens, start, end, piece, cost, order, steps)

    def weights(self, log_p: np.ndarray, byte_log_p: np.ndarray) -> np.ndarray:
        """[edges, K] log probabilities from [pieces, K] and [K]."""
        w = log_p[self.piece]
        rest = self.piece < 0
        w[rest] = self.cost[rest, None] * byte_log_p
        return w

    def forward(self, w: np.ndarray) -> np.ndarray:
        """[places, K] log sums over all segmentations up to each place."""
        return self._sums(w, self.order, self.steps, self.start, self.end, self.first)

    def backward(self, w: np.ndarray) -> np.ndarray:
        """[places, K] log sums over all segmentations from each place on."""
        places = int((self.lens + 1).sum())
        rest = np.zeros(places, dtype=np.int64)
        depth = np.arange(places) - np.repeat(self.first, self.lens + 1)
        rest = np.repeat(self.lens, self.lens + 1) - depth
        order = np.lexsort((self.start, rest[self.start]))
        steps = np.searchsorted(rest[self.start][order], np.arange(1, int(self.lens.max(initial=0)) + 2))
        return self._sums(w, order, steps, self.end, self.start, self.first + self.lens)

    def _sums(self, w, order, steps, source, target, zero):
        out = np.full((int((self.lens + 1).sum()), w.shape[1]), -np.inf)
        out[zero] = 0.0
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            edge = order[a:b]
            if len(edge):
                log_add(out, target[edge], out[source[edge]] + w[edge])
        return out


def log_add(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """out[row] = log sum exp of the values of each row; equal rows stand together."""
    cut = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    top = np.maximum.reduceat(values, cut, axis=0)
    size = np.diff(np.append(cut, len(rows)))
    safe = np.where(np.isfinite(top), top, 0.0)
    total = np.add.reduceat(np.exp(values - np.repeat(safe, size, axis=0)), cut, axis=0)
    with np.errstate(divide="ignore"):
        out[rows[cut]] = np.log(total) + safe
