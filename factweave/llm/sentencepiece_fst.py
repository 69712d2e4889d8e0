"""SentencePiece encoding and decoding by weighted finite-state transducers.

Four machines are compiled from a model file:
N, the normaliser: from its start state an arc writes the word mark of the dummy prefix; inside, a
space or a mark writes a mark and every other character itself.
P, the pieces: a trie of states whose arcs read characters; the arc that ends a piece writes its id
and leads back to the root. It weighs minus the piece's score in a unigram model, 0 in a BPE model.
B, byte fallback: for a character without a piece one arc that writes the ids of its UTF-8 bytes
(or the unknown id), at the library's penalty.
C, for BPE models: an acceptor of neighbouring pieces whose states are the piece read last. The arc
from piece x to piece y weighs 0 where merging leaves the two apart, else infinity. It is compiled
from each piece's derivation, the two pieces that merge into it: undoing the derivations of x and y
from the latest merge to the earliest gives all pairs of symbols that ever met at the boundary, and
the arc weighs 0 if none of these merges before one of its two symbols is taken up on its own side.
Pieces that share a rank (runs of marks do) have no order to undo; their arcs come from merging the two.

An input x is composed as x o N o (P | B) o C, states made as the search reaches them, and the
shortest path in the tropical semiring (min, +) is read off. A segmentation is the greedy merges'
result exactly if all its neighbouring pairs are: merges within a run of segments that nothing
crosses go on as if the run stood alone. So in a BPE model exactly one path has finite weight.

Inputs are cut before word marks that follow another character, which no piece crosses; segments
are memoised in a table of bounded size.

Defined results: null and empty texts give no ids, and decode to the empty text; equal rows give
equal results; an empty table gives no rows; texts of any length take time in proportion.
"""

from __future__ import annotations

import collections
import functools
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import MARK, Pieces
from .shared import docs_of

MODEL = "piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
#: Entries of each memo table.
MEMO = 400_000
START, INSIDE = 0, 1


def normaliser(dummy_prefix: bool) -> dict:
    """N: (state, character) to (what is written, next state); the key without a character holds for all others, written after the arc's own output."""
    arcs = {(INSIDE, " "): (MARK, INSIDE), (INSIDE, None): ("", INSIDE)}
    arcs[START, None] = (MARK if dummy_prefix else "", INSIDE)
    arcs[START, " "] = (MARK * (1 + dummy_prefix), INSIDE)
    return arcs


class Trie:
    """P: step[state, character] is the next state, written[state] the id of the piece that ends there."""

    def __init__(self, usable: dict[str, int]):
        self.step: dict[tuple[int, str], int] = {}
        self.written: dict[int, int] = {}
        states = 1
        for piece, i in usable.items():
            state = 0
            for char in piece:
                after = self.step.setdefault((state, char), states)
                states += after == states
                state = after
            self.written[state] = i


class Neighbours:
    """C: weigh(x, y) of two ids; ids below 0 are characters without a piece, which merge with nothing."""

    def __init__(self, pieces: Pieces):
        usable, score, surface = pieces.usable, pieces.score, pieces.surface
        order = {s: r for r, s in enumerate(sorted({score[i] for i in usable.values()}, reverse=True))}
        self.usable, self.surface = usable, surface
        #: When a piece is made; a character is there from the start.
        self.rank = {i: order[score[i]] if len(piece) > 1 else -1 for piece, i in usable.items()}
        often = collections.Counter(r for r in self.rank.values() if r >= 0)
        self.tied = {i for i, r in self.rank.items() if often[r] > 1}
        self.parts: dict[int, tuple[int, int]] = {}
        for piece, i in sorted(usable.items(), key=lambda p: self.rank[p[1]]):
            for cut in range(1, len(piece)):
                x, y = usable.get(piece[:cut]), usable.get(piece[cut:])
                if x is not None and y is not None and self.known(x, self.rank[i]) and self.known(y, self.rank[i]) and self.apart(x, y, self.rank[i]):
                    self.parts[i] = x, y
                    break
        self.weigh = functools.lru_cache(MEMO)(self._weigh)

    def known(self, x: int, before: int) -> bool:
        """Whether a piece is there by that time."""
        return self.rank[x] < 0 or (x in self.parts and self.rank[x] < before)

    def apart(self, x: int, y: int, before: float) -> bool:
        """Whether no symbols merge across the boundary of x and y before that rank."""
        rank, parts, usable, surface = self.rank, self.parts, self.usable, self.surface
        while True:
            joined = usable.get(surface[x] + surface[y])
            if joined is not None and rank[joined] < before:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            # of equals the left one merges first
            if rank[x] > rank[y]:
                before, x = rank[x], parts[x][1]
            else:
                before, y = rank[y] + 1, parts[y][0]

    def merged(self, text: str) -> list[str]:
        """Greedy merges of a short text: lowest rank first, leftmost of equals."""
        symbols = list(text)
        while True:
            able = [(self.rank[i], k) for k in range(len(symbols) - 1) if (i := self.usable.get(symbols[k] + symbols[k + 1])) is not None]
            if not able:
                return symbols
            k = min(able)[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    def _weigh(self, x: int, y: int) -> float:
        if x < 0 or y < 0:
            return 0.0
        if x in self.tied or y in self.tied:
            return 0.0 if self.merged(self.surface[x] + self.surface[y]) == [self.surface[x], self.surface[y]] else math.inf
        able = all(self.rank[i] < 0 or i in self.parts for i in (x, y))
        return 0.0 if able and self.apart(x, y, math.inf) else math.inf


class Transducer:
    """Compiled model. encode() and decode() map a text to ids and back."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.is_bpe = pieces.model_type == BPE
        self.normaliser = normaliser(False)  # the cut writes the dummy prefix
        self.trie = Trie(pieces.usable)
        self.neighbours = Neighbours(pieces) if self.is_bpe else None
        self.memo: dict[str, bytes] = {}
        self.floor = min(pieces.score) - 10.0
        self.written = [self._written(i) for i in range(len(pieces.surface))]

    def _written(self, i: int) -> bytes:
        kind, text = self.pieces.kind[i], self.pieces.surface[i]
        if kind == 6:
            return bytes([int(text[3:5], 16)])
        if kind == 3:
            return b""
        if kind == 2:
            return " ⁇ ".encode()
        return text.replace(MARK, " ").encode()

    def normalise(self, segment: str) -> str:
        """What N writes, from its inner state."""
        arcs, state, out = self.normaliser, INSIDE, []
        for char in segment:
            found = arcs.get((state, char))
            if found is None:
                found = arcs[state, None]
                out.append(found[0] + char)
            else:
                out.append(found[0])
            state = found[1]
        return "".join(out)

    def arcs(self, segment: str, start: int) -> list[tuple[int, int]]:
        """(end, id) of the arcs of P and B from a position on, shortest first; B's arc has minus the character's code, less 1."""
        step, written = self.trie.step, self.trie.written
        found, state = [], 0
        for end in range(start, len(segment)):
            state = step.get((state, segment[end]))
            if state is None:
                break
            i = written.get(state)
            if i is not None:
                found.append((end + 1, i))
        if not found or found[0][0] != start + 1:
            found.insert(0, (start + 1, -1 - ord(segment[start])))
        return found

    def shortest_path(self, segment: str) -> list[int]:
        """Ids of the arcs of the shortest path through N's output."""
        return self._zero_path(segment) if self.is_bpe else self._viterbi(segment)

    def _zero_path(self, segment: str) -> list[int]:
        """Uniform-cost search where finite arcs weigh 0: the first path to the end is the shortest.

        States are (position, last piece), each entered once.
        """
        n, weigh = len(segment), self.neighbours.weigh
        path, ends, todo, entered = [], [0], [self.arcs(segment, 0)], set()
        while ends[-1] < n:
            if not todo[-1]:
                todo.pop()
                if not path:
                    raise ValueError("no path")  # cannot be: the merges' own result is one
                path.pop()
                ends.pop()
                continue
            state = end, i = todo[-1].pop()
            if state in entered or (path and weigh(path[-1], i)):
                continue
            entered.add(state)
            path.append(i)
            ends.append(end)
            if end < n:
                todo.append(self.arcs(segment, end))
        return path

    def _viterbi(self, segment: str) -> list[int]:
        """Least sum of minus the scores; of equals the path whose last piece is longest."""
        n = len(segment)
        weight, last = [0.0] + [math.inf] * n, [(0, 0)] * (n + 1)
        for start in range(n):
            for end, i in self.arcs(segment, start):
                total = weight[start] - (self.floor if i < 0 else self.pieces.score[i])
                if total < weight[end]:
                    weight[end], last[end] = total, (start, i)
        path, end = [], n
        while end:
            end, i = last[end]
            path.append(i)
        return path[::-1]

    def segment_ids(self, segment: str) -> bytes:
        """Ids of a pre-token as little-endian int32."""
        found = self.memo.get(segment)
        if found is None:
            ids: list[int] = []
            for i in self.shortest_path(self.normalise(segment)):
                ids += [i] if i >= 0 else self.pieces.char_ids(chr(-1 - i))
            found = np.array(ids, "<i4").tobytes()
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(segment) <= 64:
                self.memo[segment] = found
        return found

    def encode_bytes(self, text: str | None) -> bytes:
        get, slow = self.memo.get, self.segment_ids
        return b"".join([get(s) or slow(s) for s in self.pieces.pretokens(text)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids) -> str:
        """The inverse transducer: bytes of the pieces, without the dummy prefix; ill-formed bytes become U+FFFD."""
        data = b"".join(map(self.written.__getitem__, ids))
        if self.pieces.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@functools.lru_cache(2)
def transducer(path: str) -> Transducer:
    """Compiled once in a Python worker."""
    return Transducer(Pieces(path))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, ids array<int>."""

    def apply(batches):
        fst = transducer(public_tokenizers.path(model))
        for batch in batches:
            ids = [np.frombuffer(fst.encode_bytes(x), "<i4") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return df.select(id_col, text_col).mapInArrow(apply, "doc_id long, ids array<int>")


def decode(df: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give the empty text."""

    def apply(batches):
        fst = transducer(public_tokenizers.path(model))
        for batch in batches:
            texts = [fst.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(apply, "doc_id long, text string")


def encoded_digests(df: DataFrame, model: str = MODEL) -> DataFrame:
    """For each document the count and checksum of its ids, the checksum of its decoded text, and whether that is the text."""

    def apply(batches):
        fst = transducer(public_tokenizers.path(model))
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_ids": [], "ids_crc32": [], "decoded_crc32": [], "round_trip": []}
            for text in batch.column(1).to_pylist():
                ids = fst.encode_bytes(text)
                back = fst.decode(np.frombuffer(ids, "<i4").tolist())
                out["n_ids"].append(len(ids) // 4)
                out["ids_crc32"].append(zlib.crc32(ids))
                out["decoded_crc32"].append(zlib.crc32(back.encode()))
                out["round_trip"].append(back == (text or ""))
            types = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([out["doc_id"]] + [pa.array(out[k], t) for k, t in zip(list(out)[1:], types[1:])], list(out))

    return df.select("doc_id", "text").mapInArrow(apply, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return encoded_digests(docs_of(spark, sf_dir))
