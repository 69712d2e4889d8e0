"""Token counts by rank-synchronous merging of arrays.

Pre-tokens of a batch are held as one ragged array of symbols. In each round every pre-token takes
its lowest-rank pair, all pre-tokens at once; pre-tokens without a pair that merges drop out, and
their surviving symbols are counted (a character without a piece counts its UTF-8 bytes).

Within a pre-token all places of its lowest rank merge in one round, left to right, up to the first
place whose new symbol forms a pair of the same or a lower rank: merged one by one, that pair would
come next. Pre-tokens are memoised in a table of bounded size. One that is longer than SEGMENT is
cut at likely boundaries; two neighbouring segments are right exactly if the last symbol of one and
the first of the next encode to themselves together, and are joined and counted anew where not.
Where joined ones grow long (texts that repeat without end), a heap of pairs merges them, in n log n.

Defined results: null and empty texts have no tokens; equal rows give equal counts; an empty table
gives no rows; texts of any length take time in proportion, but for that logarithm.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import MARK, Pieces
from .shared import docs_of

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MEMO = 400_000
#: Characters of a pre-token that are merged together; longer ones are cut.
SEGMENT = 256
#: So often wrong neighbours are joined before the whole pre-token goes to the heap.
JOINS = 4
#: Symbols of one ragged array.
BLOCK = 400_000
NONE = np.int64(1 << 40)


class Ranks:
    """Symbols, and for pairs of symbols the rank and the symbol they merge into."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        usable = pieces.usable
        order = {s: r for r, s in enumerate(sorted(set(pieces.score), reverse=True))}
        pairs = []
        for piece, i in usable.items():
            for cut in range(1, len(piece)):
                left, right = usable.get(piece[:cut]), usable.get(piece[cut:])
                # single characters that are no pieces of their own have symbols too
                if left is not None and right is not None:
                    pairs.append((left, right, order[pieces.score[i]], i))
        lone = [s for s in usable if len(s) > 1 and any(c not in usable for c in s)]
        if lone:
            raise ValueError("a piece holds a character that is no piece")
        self.size = len(pieces.surface)
        table = np.array(sorted((a * self.size + b, r, i) for a, b, r, i in pairs), np.int64).reshape(-1, 3)
        #: Open hashing in one array of a power of two; a slot holds a row of the table.
        self.bits = max(4, int(np.ceil(np.log2(len(table) + 1))) + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        self.into = np.zeros(1 << self.bits, np.int64)
        todo = np.arange(len(table))
        at = self._slot(table[:, 0])
        while len(todo):
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            put = todo[free][first]
            self.keys[slots], self.ranks[slots], self.into[slots] = table[put, 0], table[put, 1], table[put, 2]
            rest = ~np.isin(todo, put)
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.char: dict[str, int] = {c: i for c, i in usable.items() if len(c) == 1}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where nothing merges) and merged symbol of pairs; symbols below 0 merge with nothing."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left * self.size + right)
        at = self._slot(keys)
        rank, into = np.full(len(keys), NONE), np.zeros(len(keys), np.int64)
        open_ = np.flatnonzero(keys >= 0)
        at = at[open_]
        while len(open_):
            seen = self.keys[at]
            hit = seen == keys[open_]
            rank[open_[hit]], into[open_[hit]] = self.ranks[at[hit]], self.into[at[hit]]
            go = ~hit & (seen >= 0)
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return rank, into

    @functools.cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and merged symbol of left * size + right."""
        used = np.flatnonzero(self.keys >= 0)
        return dict(zip(self.keys[used].tolist(), zip(self.ranks[used].tolist(), self.into[used].tolist())))

    def symbols(self, text: str) -> list[int]:
        """Symbols of a text's characters: a piece's id, or minus the number of byte pieces (unknown: -1)."""
        get = self.char.get
        out = [get(c) for c in text]
        if None in out:
            out = [s if s is not None else -(len(c.encode("utf-8", "surrogatepass")) if self.pieces.bytes else 1) for s, c in zip(out, text)]
        return out


def merge(ranks: Ranks, sequences: list[list[int]]) -> list[np.ndarray]:
    """Surviving symbols of each sequence after all merges."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(sequences)
    sizes = np.array([len(s) for s in sequences], np.int64)
    for owners, symbols, starts in rounds(ranks, np.array([x for s in sequences for x in s], np.int64), sizes):
        for k, part in zip(owners, np.split(symbols, starts[1:])):
            out[k] = part.copy()
    return out


def merged_counts(ranks: Ranks, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens of each sequence; sequence k holds the next sizes[k] symbols."""
    out = np.zeros(len(sizes), np.int64)
    for owners, rest, starts in rounds(ranks, symbols, sizes):
        out[owners] = np.add.reduceat(np.where(rest < 0, -rest, 1), starts)
    return out


def rounds(ranks: Ranks, symbols: np.ndarray, sizes: np.ndarray):
    """Merge until nothing merges; yields (numbers of the sequences that ended, their symbols, where each starts)."""
    owner = np.flatnonzero(sizes)
    seq = np.repeat(np.arange(len(owner), dtype=np.int32), sizes[owner])

    def pair_ranks(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(where + 1, len(symbols) - 1)
        inside = (where + 1 < len(symbols)) & (seq[after] == seq[where])
        return ranks.look_up(np.where(inside, symbols[where], -1), symbols[after])

    rank, into = pair_ranks(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        over = lowest == NONE
        if over.any():
            sizes_now = np.diff(np.r_[starts, len(symbols)])
            keep = ~np.repeat(over, sizes_now)
            ended = sizes_now[over]
            yield owner[seq[starts[over]]], symbols[~keep], np.cumsum(ended) - ended
            symbols, seq, rank, into = symbols[keep], seq[keep], rank[keep], into[keep]
            if not len(symbols):
                break
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = lowest[~over]
        counts = np.diff(np.r_[starts, len(symbols)])
        places = np.flatnonzero(rank == np.repeat(lowest, counts))
        # of places that overlap, every other one from the left
        new_run = np.r_[True, np.diff(places) != 1] if len(places) else np.zeros(0, bool)
        run = np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
        places = places[(np.arange(len(places)) - run) % 2 == 0]
        made, least = into[places], rank[places]
        # the symbol before: what the place before merged into, if it ended there
        before = np.maximum(places - 1, 0)
        left = np.where((places > 0) & (seq[before] == seq[places]), symbols[before], -1)
        joined = np.r_[False, (places[1:] - places[:-1] == 2) & (seq[places[1:]] == seq[places[:-1]])]
        left[joined] = made[np.flatnonzero(joined) - 1]
        behind = np.minimum(places + 2, len(symbols) - 1)
        right = np.where((places + 2 < len(symbols)) & (seq[behind] == seq[places]), symbols[behind], -1)
        stop = (ranks.look_up(left, made)[0] <= least) | (ranks.look_up(made, right)[0] <= least)
        # places after the first stop of their sequence wait
        first = np.r_[True, seq[places[1:]] != seq[places[:-1]]]
        group = np.cumsum(first) - 1
        stops_before = np.cumsum(stop) - stop
        places_ok = stops_before == stops_before[np.flatnonzero(first)][group]
        places, made = places[places_ok], made[places_ok]
        symbols[places] = made
        gone = np.zeros(len(symbols), bool)
        gone[places + 1] = True
        touched = np.zeros(len(symbols), bool)
        touched[places] = True
        touched[np.maximum(places - 1, 0)] = True
        # a place's left neighbour may be the gone half of another pair
        lefts = np.maximum(places - 1, 0)
        touched[np.maximum(lefts - gone[lefts], 0)] = True
        keep = ~gone
        symbols, seq, rank, into, touched = symbols[keep], seq[keep], rank[keep], into[keep], np.flatnonzero(touched[keep])
        rank[touched], into[touched] = pair_ranks(touched)


def merge_one(ranks: Ranks, symbols: list[int]) -> np.ndarray:
    """Surviving symbols of one sequence: a heap holds its pairs, the lowest rank first, the leftmost of equals."""
    pairs, size, n = ranks.pairs, ranks.size, len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))

    def pair(at: int):
        right = after[at]
        if right < n and symbols[at] >= 0 and symbols[right] >= 0:
            found = pairs.get(symbols[at] * size + symbols[right])
            if found:
                return found[0], at, symbols[at], symbols[right], found[1]

    heap = [p for p in map(pair, range(n)) if p]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, at, left, other, made = heapq.heappop(heap)
        right = after[at]
        if gone[at] or right >= n or symbols[at] != left or symbols[right] != other:
            continue
        symbols[at] = made
        gone[right] = 1
        after[at] = after[right]
        if after[at] < n:
            before[after[at]] = at
        for place in (before[at], at):
            new = pair(place) if place >= 0 else None
            if new:
                heapq.heappush(heap, new)
    return np.array([s for s, g in zip(symbols, gone) if not g], np.int64)


def weight(symbols: np.ndarray) -> int:
    """Tokens that the symbols stand for."""
    return int(np.where(symbols < 0, -symbols, 1).sum())


class Counter:
    """Counts tokens of texts in batches."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.ranks, self.memo = pieces, Ranks(pieces), {}

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.pieces.pretokens(x) for x in texts]
        known = self.memo
        if len(known) > MEMO:
            known.clear()
        missing = set().union(*split).difference(known)
        short = [w for w in missing if len(w) <= SEGMENT]
        found: dict[str, int] = {}
        at = 0
        while at < len(short):
            take, total = at, 0
            while take < len(short) and total < BLOCK:
                total += len(short[take])
                take += 1
            block = short[at:take]
            symbols = np.array(self.ranks.symbols("".join(block).replace(" ", MARK)), np.int64)
            found.update(zip(block, merged_counts(self.ranks, symbols, np.array(list(map(len, block)), np.int64)).tolist()))
            at = take
        for w in missing:
            if len(w) > SEGMENT:
                found[w] = self.count_long(w.replace(" ", MARK))
        known.update(found)
        out = [sum(map(known.__getitem__, words)) for words in split]
        for w in missing:
            if len(w) > 64:
                del known[w]
        return out

    def count_long(self, text: str) -> int:
        """Tokens of one long pre-token."""
        ranks, half = self.ranks, 32
        wanted = list(range(SEGMENT, len(text) - half, SEGMENT))
        windows = merge(ranks, [ranks.symbols(text[c - half : c + half]) for c in wanted])
        cuts = [0]
        for c, symbols in zip(wanted, windows):
            ends = np.cumsum([len(self.pieces.surface[s]) if s >= 0 else 1 for s in symbols])
            near = c - half + int(ends[np.argmin(np.abs(ends - half))])
            if cuts[-1] < near < len(text):
                cuts.append(near)
        segments = [text[a:b] for a, b in zip(cuts, cuts[1:] + [len(text)])]
        parts = merge(ranks, [ranks.symbols(s) for s in segments])
        for _ in range(JOINS):
            pairs = [[int(a[-1]), int(b[0])] for a, b in zip(parts, parts[1:])]
            chars = [self._characters(a) + self._characters(b) for a, b in pairs]
            right = [list(got) == pair for got, pair in zip(merge(ranks, chars), pairs)]
            if all(right):
                return sum(weight(p) for p in parts)
            firsts = [0] + [k for k, ok in enumerate(right, 1) if ok]
            bounds = list(zip(firsts, firsts[1:] + [len(segments)]))
            joined = ["".join(segments[a:b]) for a, b in bounds]
            parts = [parts[a] if b == a + 1 else None for a, b in bounds]
            anew = [k for k, p in enumerate(parts) if p is None]
            short = [k for k in anew if len(joined[k]) <= 4 * SEGMENT]
            for k, p in zip(short, merge(ranks, [ranks.symbols(joined[k]) for k in short])):
                parts[k] = p
            for k in anew:
                if parts[k] is None:
                    parts[k] = merge_one(ranks, ranks.symbols(joined[k]))
            segments = joined
        return weight(merge_one(ranks, ranks.symbols(text)))

    def _characters(self, symbol: int) -> list[int]:
        return [symbol] if symbol < 0 else self.ranks.symbols(self.pieces.surface[symbol])


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(Pieces(path))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""

    def apply(batches):
        count = counter(public_tokenizers.path(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(1).to_pylist()
                n = count.count(texts)
                sizes = [len(x.encode("utf-8", "surrogatepass")) if x else 0 for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return df.select(id_col, text_col).mapInArrow(apply, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(docs_of(spark, sf_dir))
