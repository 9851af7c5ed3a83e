"""Best-fit packing of documents into sequences of several permitted lengths.

A sequence costs what starting it takes, its length, and attention, which grows
with the square of the length. So long sequences waste attention, short ones
starts, and unfilled ones length: the permitted lengths are optimised jointly.

Documents are dealt to blocks of bounded size, which are packed each for
itself: longest first, each piece into the open bin that it fills best; if none
has room, the bin with the least cost for each token that it is expected to hold
is opened, given the pieces that are still to come and the room that is open.
This is done with every subset of the permitted lengths, and the cheapest packing
of the block stands. Then every bin shrinks to the smallest permitted size that
holds its contents, and loose bins are taken apart and packed anew, exactly.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_map, texts_of, written

#: Permitted sequence lengths in tokens.
SIZES = (512, 1024, 2048, 4096, 8192)
#: What starting a sequence takes, in tokens; and the length at which attention costs as much as all else of a token.
OVERHEAD, ATTENTION = 64, 65_536
#: Documents, and pieces of them, that are packed together.
BLOCK_DOCS, BLOCK_PIECES = 20_000, 1 << 20
#: Pieces that are packed exactly, and how many loose bins are taken apart.
EXACT, LOOSE = 9, 200

Piece = tuple[int, int, int]


class Costs:
    """The permitted sizes and what a sequence of each costs."""

    def __init__(self, sizes: tuple[int, ...], overhead: int, attention: int):
        self.sizes = tuple(sorted(sizes))
        self.of = {c: overhead + c + c * c / attention for c in self.sizes}

    def held(self, tokens: int) -> float:
        """Of the smallest size that holds so many tokens."""
        return self.of[self.sizes[bisect_left(self.sizes, tokens)]]

    def total(self, bins: list[list[Piece]]) -> float:
        return sum(self.held(sum(p[0] for p in b)) for b in bins)

    def bound(self, lengths: list[int]) -> float:
        """No packing costs less: every token of a piece costs at least as in a full sequence of the best size that can hold the piece."""
        rates = [min(self.of[c] / c for c in self.sizes[k:]) for k in range(len(self.sizes))]
        return sum(n * rates[bisect_left(self.sizes, n)] for n, _, _ in pieces_of(lengths, self.sizes[-1]))


def pieces_of(lengths: list[int], largest: int) -> list[tuple[int, int, int]]:
    """(length, document, start) of each piece: documents longer than the largest size are cut into such and a rest."""
    return [(min(largest, n - s), k, s) for k, n in enumerate(lengths) for s in range(0, max(n, 1), largest)]


def packed(pieces: list[Piece], later: list[int], allowed: tuple[int, ...], costs: Costs) -> list[list[Piece]]:
    """Bins of pieces sorted longest first, with these sizes to be opened. later: by place, the tokens of the pieces from there on."""
    bins: list[list[Piece]] = []
    room: list[int] = []  # of the bins that are open, ascending, with the bins of each below
    at: dict[int, list[int]] = {}
    free_total = 0
    lengths = [-p[0] for p in pieces]
    for k, piece in enumerate(pieces):
        size = piece[0]
        i = bisect_left(room, size)
        if i < len(room):
            free = room[i]
            b = at[free].pop()
            if not at[free]:
                del at[free]
                room.pop(i)
            free_total -= size
        else:
            best = None
            for c in allowed:
                if c >= size:
                    fill = later[max(k + 1, bisect_left(lengths, size - c, k + 1))] - free_total if c > size else 0
                    rate = costs.of[c] / max(1, size + min(c - size, max(0, fill)))
                    if best is None or rate < best[0]:
                        best = (rate, c)
            free = best[1]
            b = len(bins)
            bins.append([])
            free_total += free - size
        bins[b].append(piece)
        free -= size
        if free:
            if free not in at:
                at[free] = []
                insort(room, free)
            at[free].append(b)
    return bins


def packed_exactly(pieces: list[Piece], costs: Costs) -> list[list[Piece]]:
    """The cheapest packing of a few pieces, by the best bin that holds the first piece of each set of pieces."""
    n = len(pieces)
    held = [0] * (1 << n)
    for s in range(1, 1 << n):
        low = (s & -s).bit_length() - 1
        held[s] = held[s & (s - 1)] + pieces[low][0]
    best: list[tuple[float, int]] = [(0.0, 0)] * (1 << n)
    largest = costs.sizes[-1]
    for s in range(1, 1 << n):
        first = s & -s
        rest, part, least = s ^ first, s ^ first, None
        while True:
            own = part | first
            if held[own] <= largest:
                cost = costs.held(held[own]) + best[s ^ own][0]
                if least is None or cost < least[0]:
                    least = (cost, own)
            if part == 0:
                break
            part = (part - 1) & rest
        best[s] = least
    out, s = [], (1 << n) - 1
    while s:
        own = best[s][1]
        out.append([pieces[k] for k in range(n) if own >> k & 1])
        s ^= own
    return out


def polished(bins: list[list[Piece]], costs: Costs) -> list[list[Piece]]:
    """The loosest bins, some at a time, packed anew where that is cheaper."""
    loss = lambda b: costs.held(t := sum(p[0] for p in b)) - t * min(c / s for s, c in costs.of.items())
    order = sorted(range(len(bins)), key=lambda k: (-loss(bins[k]), k))
    loose, rest = [bins[k] for k in order[:LOOSE]], [bins[k] for k in order[LOOSE:]]
    done: list[list[Piece]] = []
    while loose:
        some, loose = [loose[0]], loose[1:]
        count, kept = len(some[0]), []
        for b in loose:
            if count + len(b) <= EXACT:
                some.append(b)
                count += len(b)
            else:
                kept.append(b)
        if count <= EXACT:
            new = packed_exactly(sorted((p for b in some for p in b), key=lambda p: (-p[0], p[1], p[2])), costs)
            if costs.total(new) < costs.total(some) - 1e-9:
                some = new
        done += some
        loose = kept
    return rest + done


def pack_block(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[list[Piece]], list[int]]:
    """The cheapest packing found of documents with these lengths: bins of (length, document, start), and their sizes."""
    costs = Costs(sizes, overhead, attention)
    pieces = sorted(pieces_of(lengths, costs.sizes[-1]), key=lambda p: (-p[0], p[1], p[2]))
    if len(pieces) <= EXACT:
        bins = packed_exactly(pieces, costs) if pieces else []
    else:
        later = [0]
        for p in reversed(pieces):
            later.append(later[-1] + p[0])
        later.reverse()
        subsets = [s for r in range(1, len(costs.sizes) + 1) for s in combinations(costs.sizes, r) if s[-1] >= pieces[0][0]]
        bins = min((packed(pieces, later, s, costs) for s in subsets), key=costs.total)
        bins = polished(bins, costs)
    return bins, [costs.sizes[bisect_left(costs.sizes, sum(p[0] for p in b))] for b in bins]


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_tokens): words between ASCII white space, and one for the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.split()) + 1 for t in texts_of(b.column(1))], pa.int64())], names=["id", "n_tokens"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return arrow_map(src, run, "id long, n_tokens long").withColumnRenamed("id", id_col)


def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> DataFrame:
    """Rows (id_col, piece_start, piece_tokens, bin_id, bin_size, bin_offset), one for each piece of a document.

    Null, zero and negative lengths count as zero: such a document takes no room
    but has its row. Repeated ids are documents of their own; null ids are
    packed like others; of equal lengths the smaller id goes first; an empty
    table gives no rows; other columns are not read.
    """
    src = written(lengths.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long").alias("n")), "lengths")
    n_blocks, largest = max(1, -(-src.count() // BLOCK_DOCS)), max(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        docs = pieces = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, block, docs, pieces
            t = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("n", "ascending")])
            held, docs, pieces = [], 0, 0
            bins, final = pack_block(t.column("n").to_pylist(), sizes, overhead, attention)
            if len(bins) >= 1 << 24:
                raise ValueError("a block has too many bins to be numbered")
            rows = []
            for k, (b, size) in enumerate(zip(bins, final, strict=True)):
                offset = 0
                for n, doc, start in b:
                    rows.append((doc, start, n, (part << 40) + (block << 24) + k, size, offset))
                    offset += n
            block += 1
            cols = np.array(rows, dtype=np.int64).reshape(-1, 6)
            ids = t.column("id").combine_chunks().take(pa.array(cols[:, 0]))
            return pa.RecordBatch.from_arrays([ids, *(pa.array(cols[:, k]) for k in range(1, 6))], names=["id", "piece_start", "piece_tokens", "bin_id", "bin_size", "bin_offset"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                docs += b.num_rows
                pieces += int((b.column(1).to_numpy() // largest + 1).sum())
            if docs >= 2 * BLOCK_DOCS or pieces >= BLOCK_PIECES:
                yield flush()
        if held:
            yield flush()

    out = arrow_map(src.repartition(n_blocks), run, "id long, piece_start long, piece_tokens long, bin_id long, bin_size long, bin_offset long")
    return out.withColumnRenamed("id", id_col)
