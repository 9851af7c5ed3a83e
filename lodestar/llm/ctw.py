"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has, for every context of the
last 0 to 5 bytes, a Krichevsky-Trofimov estimate from the training texts. A
node's weighted probability is the mean of its own estimate's and of its
children's product, so the prediction mixes the estimates of all depths. Texts
end with the byte 255, which UTF-8 never holds, and start after five of them.

Texts are dealt to blocks of bounded size. Each block counts its distinct
six-byte grams, packed into one row for each three-byte context, and its words;
the counts are summed over groups of blocks and then over the groups, so that no
task gets a frequent context's rows of all blocks, the weighting is worked out from the
leaves in groups whose size is bounded by the alphabet (the grams of one
three-byte context, the children of one node), and the values of its own grams
and words go back to every block. Neither the model nor a vocabulary is ever
gathered or broadcast whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_map, small_batches, texts_of, written

#: Context bytes of the deepest nodes.
DEPTH = 5
#: Bytes of text dealt to a block on average, and scanned at once within one.
BLOCK_BYTES, SCAN_BYTES = 16 << 20, 2 << 20
#: Blocks whose rows of one context come together.
GROUP_BLOCKS = 256
#: Rows that a task gives back at once, and grams that are looked up at once.
ROWS_OUT, ASKED_AT_ONCE = 20_000, 1 << 18
_END = b"\xff"
_LOWER = bytes(32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_HALF = math.log(0.5)
_LGAMMA_HALF = np.array([math.lgamma(n + 0.5) for n in range(4096)])
_LGAMMA_ONE = np.array([math.lgamma(n + 1.0) for n in range(4096)])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""

    def lg(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
        small = n < len(table)
        out = table[np.where(small, n, 0).astype(np.int64)]
        return out if small.all() else np.where(small, out, _stirling(np.maximum(n, 1) + shift))

    return lg(zeros, _LGAMMA_HALF, 0.5) + lg(ones, _LGAMMA_HALF, 0.5) - lg(zeros + ones, _LGAMMA_ONE, 1.0) - 2 * _LGAMMA_HALF[0]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts and their ends: the five bytes before, the latest in the highest place, and the byte; and each text's count."""
    pad = _END * DEPTH
    a = np.frombuffer(pad + (_END + pad).join(texts) + _END, dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    key = np.zeros(len(a) - DEPTH, dtype=np.uint64)
    for back in range(1, DEPTH + 1):
        key = key << np.uint64(8) | a[DEPTH - back : len(a) - back]
    key = key << np.uint64(8) | a[DEPTH:]
    starts = np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]])
    real = np.zeros(len(key), dtype=np.int8)
    real[starts] += 1
    stops = starts + sizes
    real[stops[stops < len(key)]] -= 1
    return key[np.cumsum(real) > 0], sizes


def words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space with A-Z lower-cased, and the number of words up to each text's end."""
    a = np.frombuffer(b" ".join([*texts, b""]).translate(_LOWER), dtype=np.uint8)
    inside = np.concatenate([[False], a != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[inside[1:-1]])])
    return out, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))


def scans(texts: list[bytes]) -> Iterator[slice]:
    """Slices of the texts of about SCAN_BYTES each."""
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= SCAN_BYTES:
            yield slice(first, k + 1)
            first, size = k + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (of 48 bits), and how many of each are for training."""
    x = np.sort(keys << np.uint64(1) | train)
    keys = x >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat((x & np.uint64(1)).astype(np.int64), first)


def planes(low: np.ndarray) -> bytes:
    """Grams' three low bytes, place by place, which compresses well as they are sorted."""
    return low.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    a, b, c = np.frombuffer(data, dtype=np.uint8).reshape(3, -1).astype(np.int64)
    return a << 16 | b << 8 | c


def narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest takes."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if counts.max(initial=0) <= np.iinfo(k).max)
    return counts.astype(kind).tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // max(1, n)}").astype(np.int64)


def values_of(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of keys, which are ascending; every key asked for must be there. Each distinct one is looked up once, in order."""
    distinct, at = np.unique(asked, return_inverse=True)
    found = np.searchsorted(keys, distinct)
    if len(distinct) and (found[-1] >= len(keys) or (keys[found] != distinct).any()):
        raise KeyError("a gram without a value")
    return values[found][at]


class Grams:
    """Grams with their counts gathered piece by piece; no more than the distinct ones are held for long."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > 1 << 20 and len(self.held) > 1:
            self.held = [self.total()]
            self.size = 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*(np.concatenate(x) for x in zip(*self.held, strict=True)))


def parts_of(b: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of equal values of the (number) columns ``names`` in a batch, with those values."""
    cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names]
    new = np.ones(b.num_rows, dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    starts = np.flatnonzero(new).tolist()
    for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
        yield tuple(int(c[s]) for c in cols), b.slice(s, e - s)


def counts_out(block: int, held: Grams, found: list[pa.Array], seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A block's rows (block, ctx, keys, counts, word, n), so many at once."""

    def batch(rows: int, **cols: pa.Array) -> pa.RecordBatch:
        every = {"block": np.full(rows, block, dtype=np.int32)} | {k: cols.get(k, pa.nulls(rows, t)) for k, t in (("ctx", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("word", pa.binary()), ("n", pa.int64()))}
        return pa.RecordBatch.from_pydict(every)

    k, c = held.total()
    ctx = (k >> np.uint64(24)).astype(np.int32)
    low = (k & np.uint64(0xFFFFFF)).astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    ends = np.append(first[1:], len(k))
    for s in range(0, len(first), ROWS_OUT):
        spans = list(zip(first[s : s + ROWS_OUT].tolist(), ends[s : s + ROWS_OUT].tolist(), strict=True))
        yield batch(len(spans), ctx=pa.array(ctx[first[s : s + ROWS_OUT]]), keys=pa.array([planes(low[a:b]) for a, b in spans], pa.binary()), counts=pa.array([narrow(c[a:b]) for a, b in spans], pa.binary()))
    coded = pa.chunked_array(found, type=pa.binary()).combine_chunks().dictionary_encode()
    w, n = coded.dictionary, np.bincount(coded.indices.to_numpy(), np.concatenate(seen), minlength=len(coded.dictionary))
    for s in range(0, len(w), ROWS_OUT):
        own = w.slice(s, ROWS_OUT)
        yield batch(len(own), word=own, n=pa.array(n[s : s + ROWS_OUT].astype(np.int64)))


def block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (block, text, held_out) sorted by block: the distinct grams and words of each block with their
    counts in its training texts. Texts are let go as they are counted."""
    now, held, found, seen = None, Grams(), [], []
    for b in batches:
        for (block,), part in parts_of(b, ["block"]):
            if block != now:
                if now is not None:
                    yield from counts_out(now, held, found, seen)
                now, held, found, seen = block, Grams(), [], []
            texts, train = texts_of(part.column("text")), ~part.column("held_out").to_numpy(zero_copy_only=False)
            for s in scans(texts):
                key, sizes = grams(texts[s])
                held.add(*counted(key, np.repeat(train[s], sizes).astype(np.uint64)))
                w, ends = words(texts[s])
                coded = w.dictionary_encode()
                owner = np.repeat(train[s], np.diff(np.concatenate([[0], ends])))
                found.append(coded.dictionary)
                seen.append(np.bincount(coded.indices.to_numpy(), owner, minlength=len(coded.dictionary)))
    if now is not None:
        yield from counts_out(now, held, found, seen)


class Subtree:
    """The nodes at depths 3 to 5 under one three-byte context, for all of its grams (their three low bytes) and their eight decisions."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        low = keys
        level = np.arange(8)[:, None]
        symbol = low & 255
        self.q = ((1 << level) | (symbol >> (8 - level))).ravel()
        self.bit = ((symbol >> (7 - level)) & 1).ravel()
        counts = np.tile(counts.astype(np.float64), 8)
        ids = np.tile(low >> 8, 8) << 8 | self.q
        self.at, self.zeros, self.ones, self.kt, self.pw, child = [], [], [], [], [], None
        for depth in (5, 4, 3):
            if child is None:
                nodes, at = np.unique(ids, return_inverse=True)
                total, ones = np.bincount(at, counts), np.bincount(at, counts * self.bit)
                inside = np.zeros(len(nodes))
                self.at.append(at)
            else:
                nodes, up = np.unique((child >> 16) << 8 | child & 255 if depth == 4 else child & 255, return_inverse=True)
                total, ones = np.bincount(up, self.zeros[-1] + self.ones[-1]), np.bincount(up, self.ones[-1])
                inside = np.bincount(up, self.pw[-1])
                self.at.append(up[self.at[-1]])
            kt = log_kt(total - ones, ones)
            self.zeros.append(total - ones)
            self.ones.append(ones)
            self.kt.append(kt)
            self.pw.append(kt if depth == 5 else np.logaddexp(kt, inside) + _HALF)
            child = nodes
        self.prefixes = child

    def predictions(self) -> np.ndarray:
        """The mixed probability of each decision as seen from depth 3."""
        p = None
        for at, zeros, ones, kt, pw in zip(self.at, self.zeros, self.ones, self.kt, self.pw, strict=True):
            own = ((np.where(self.bit == 1, ones[at], zeros[at])) + 0.5) / (zeros[at] + ones[at] + 1)
            w = np.exp(_HALF + kt - pw)[at]
            p = own if p is None else w * own + (1 - w) * p
        return p


def _dense(slots: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(256)
    out[slots] = values
    return out


def _pack(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """From sorted rows (a key's columns ..., keys, counts): for each batch the keys that end in it, with their summed grams."""
    now, context = None, Grams()
    for b in batches:
        rows = []
        cols = [c.to_pylist() for c in b.columns]
        for *key, keys, counts in zip(*cols, strict=True):
            if key != now:
                if now is not None:
                    rows.append((*now, *context.total()))
                now, context = key, Grams()
            k = unplanes(keys)
            context.add(k, widened(counts, len(k)))
        yield rows
    if now is not None:
        yield [(*now, *context.total())]


def grouped(pieces: DataFrame) -> DataFrame:
    """The pieces (grp, ctx, keys, counts) of each group of blocks as one for each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in contexts(batches):
            yield _pack([(g, c, planes(k), narrow(n)) for c, g, k, n in found], ["grp", "ctx", "keys", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    placed = pieces.select("ctx", "grp", "keys", "counts").repartition("ctx", "grp").sortWithinPartitions("ctx", "grp")
    return arrow_map(placed, run, "grp int, ctx int, keys binary, counts binary")


def subtrees(pieces: DataFrame) -> DataFrame:
    """Rows (ctx, ctx2, keys, counts, sums) from pieces (ctx, keys, counts): the summed grams of each three-byte
    context and, for the 256 prefixes of a byte, their counts of zeros and ones and log weighted probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in contexts(batches):
            rows = []
            for ctx, keys, counts in found:
                tree = Subtree(keys, counts)
                sums = np.concatenate([_dense(tree.prefixes, x[-1]) for x in (tree.zeros, tree.ones, tree.pw)])
                rows.append((ctx, ctx >> 8, planes(keys), narrow(counts), sums.tobytes()))
            yield _pack(rows, ["ctx", "ctx2", "keys", "counts", "sums"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    placed = pieces.select("ctx", "keys", "counts").repartition("ctx").sortWithinPartitions("ctx")
    return arrow_map(placed, run, "ctx int, ctx2 int, keys binary, counts binary, sums binary")


def merged(children: list[bytes]) -> np.ndarray:
    """The sums of a node's 256 prefixes from those of its (at most 256) children: zeros, ones, log weighted probability."""
    zeros, ones, inside = np.sum([np.frombuffer(c).reshape(3, 256) for c in children], axis=0)
    return np.stack([zeros, ones, np.logaddexp(log_kt(zeros, ones), inside) + _HALF])


def weight_and_one(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By prefix: a node's own share of the mixture, and its estimate of a one."""
    zeros, ones, pw = sums
    return np.exp(_HALF + log_kt(zeros, ones) - pw), (ones + 0.5) / (zeros + ones + 1)


def gram_values(pieces: DataFrame, n_blocks: int) -> DataFrame:
    """Rows (block, ctx, keys, values) for each piece: the natural log of the mixture's probability of each gram's last byte, as 32-bit floats."""
    pieces = pieces.withColumn("grp", F.floor(F.col("block") / GROUP_BLOCKS).cast("int"))
    n_groups = -(-n_blocks // GROUP_BLOCKS)
    some = written(grouped(pieces), "groups") if n_groups > 1 else pieces
    low = written(subtrees(some), "subtrees")

    def up(t: pa.Table, into: str) -> pa.Table:
        return pa.table({into: t.column(into).slice(0, 1), "sums": pa.array([merged(t.column("sums").to_pylist()).tobytes()])})

    two = written(low.select("ctx2", "sums").groupBy("ctx2").applyInArrow(lambda t: up(t, "ctx2"), "ctx2 int, sums binary"), "contexts")
    one = two.select(F.shiftright("ctx2", 8).alias("ctx1"), "sums").groupBy("ctx1").applyInArrow(lambda t: up(t, "ctx1"), "ctx1 int, sums binary").collect()  # at most 256 rows of 6 KB
    root = weight_and_one(merged([bytes(r["sums"]) for r in one])) if one else None
    first = {r.ctx1: weight_and_one(np.frombuffer(r["sums"]).reshape(3, 256)) for r in one}

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ctx2, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ones, rest = np.zeros(256), np.ones(256)
                for w, p in (root, first[ctx2 >> 8], weight_and_one(np.frombuffer(sums).reshape(3, 256))):
                    ones, rest = ones + rest * w * p, rest * (1 - w)
                rows.append((ctx2, np.stack([ones, rest]).tobytes()))
            yield _pack(rows, ["ctx2", "top"], [pa.int32(), pa.binary()])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = value = None
        for b in batches:
            rows = []
            for block, ctx, data, counts, shallow in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                own = unplanes(data)
                if block is None:  # the context's summed grams come before its pieces
                    tree = Subtree(own, widened(counts, len(own)))
                    ones, rest = np.frombuffer(shallow).reshape(2, 256)
                    p = np.where(tree.bit == 1, ones[tree.q], 1 - rest[tree.q] - ones[tree.q]) + rest[tree.q] * tree.predictions()
                    keys, value = own, np.log(p).reshape(8, -1).sum(axis=0).astype("<f4")
                else:
                    rows.append((block, ctx, data, value[np.searchsorted(keys, own)].tobytes()))
            yield _pack(rows, ["block", "ctx", "keys", "values"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    top = arrow_map(two, mixed, "ctx2 int, top binary")
    null = F.lit(None)
    models = low.join(top, "ctx2").select(null.cast("int").alias("block"), "ctx", "keys", "counts", "top")
    # A context's model goes to each group of blocks that has it.
    models = models.join(some.select("ctx", "grp"), "ctx") if n_groups > 1 else models.withColumn("grp", F.lit(0))
    models = models.select("block", "ctx", "keys", "counts", "top", "grp")
    asked = pieces.select("block", "ctx", "keys", null.cast("binary").alias("counts"), null.cast("binary").alias("top"), "grp")
    placed = models.unionAll(asked).repartition("ctx", "grp").sortWithinPartitions("ctx", "grp", "block").drop("grp")
    return arrow_map(placed, values, "block int, ctx int, keys binary, values binary")


def spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets of binary values without nulls, and the bytes that they are of."""
    at = np.frombuffer(column.buffers()[1], dtype="<i8" if pa.types.is_large_binary(column.type) else "<i4")
    data = column.buffers()[2]
    return at[column.offset : column.offset + len(column) + 1].astype(np.int64), np.frombuffer(data if data is not None else b"", dtype=np.uint8)


def keys_of(ctx: np.ndarray, planed: pa.Array) -> np.ndarray:
    """The whole grams of rows of a context and its grams' low bytes, as :func:`planes` has them."""
    at, data = spans_of(planed)
    sizes = np.diff(at) // 3
    n = np.repeat(sizes, sizes)
    place = np.repeat(at[:-1] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(n))
    low = data[place].astype(np.uint64) << np.uint64(16) | data[place + n].astype(np.uint64) << np.uint64(8) | data[place + 2 * n]
    return np.repeat(ctx.astype(np.uint64) << np.uint64(24), sizes) | low


class Known:
    """The values of a block's grams and the counts of its words, as they come: the grams in ascending order."""

    def __init__(self):
        self.keys, self.values, self.words, self.n = [], [], [], []

    def add_grams(self, t: pa.RecordBatch) -> None:
        self.keys.append(keys_of(t.column("ctx").to_numpy(zero_copy_only=False), t.column("data")))
        at, data = spans_of(t.column("values"))
        self.values.append(data[at[0] : at[-1]].copy().view("<f4"))

    def add_words(self, t: pa.RecordBatch) -> None:
        self.words.append(t.column("data"))
        self.n.append(t.column("n").to_numpy(zero_copy_only=False).astype(np.int64))

    def close(self) -> None:
        self.keys, self.values = np.concatenate(self.keys), np.concatenate(self.values)
        self.words = pa.chunked_array(self.words, type=self.words[0].type if self.words else pa.binary()).combine_chunks()
        self.n = np.concatenate([np.zeros(0, dtype=np.int64), *self.n])

    def score(self, texts: list[bytes], total: int, distinct: int, end: int) -> dict[str, np.ndarray]:
        room = total + 0.5 * (distinct + 1)
        k, sizes = grams(texts)
        v = np.empty(len(k))
        for s in range(0, len(k), ASKED_AT_ONCE):
            v[s : s + ASKED_AT_ONCE] = values_of(self.keys, self.values, k[s : s + ASKED_AT_ONCE])
        score = np.add.reduceat(v, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / math.log(10)
        tokens, ends = words(texts)
        c = self.n[pa.compute.index_in(tokens.cast(self.words.type), value_set=self.words).to_numpy()] if len(tokens) else np.zeros(0)
        owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        base = np.bincount(owner, np.log10((c + 0.5) / room), minlength=len(ends)) + math.log10((end + 0.5) / room)
        n_tokens = np.bincount(owner, minlength=len(ends)).astype(np.int64) + 1
        n_known = np.bincount(owner, c > 0, minlength=len(ends)).astype(np.int64) + (end > 0)
        return {"n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(len(texts), total), "base_score": base, "score": score, "n_bytes": sizes - 1}


def scored(batches: Iterator[pa.RecordBatch], total: int, distinct: int, end: int) -> Iterator[pa.RecordBatch]:
    """Scores of texts from rows (block, kind, ctx, data, values, n, id, held_out) sorted by the first three: each block's grams (kind 0)
    and words (1), which are held as arrays, then its texts (2), of which a few are held at once."""
    now, known, ready = None, Known(), False
    for b in batches:
        for (block, kind), part in parts_of(b, ["block", "kind"]):
            if block != now:
                now, known, ready = block, Known(), False
            if kind < 2:
                (known.add_words if kind else known.add_grams)(part)
                continue
            if not ready:
                known.close()
                ready = True
            texts, ids, held_out = texts_of(part.column("data")), part.column("id"), part.column("held_out")
            for s in scans(texts):
                own = {"id": ids.slice(s.start, s.stop - s.start), "held_out": held_out.slice(s.start, s.stop - s.start)}
                yield pa.RecordBatch.from_pydict(own | known.score(texts[s], total, distinct, end))


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    Learns from the whole texts of rows where ``held_out`` is not true and
    scores all rows. score: log10 probability of the text and its end by the
    weighted context trees; base_score: by add-half word counts. Null texts are
    empty (one token, the end); with no training rows all estimates are those
    of unseen contexts; repeated rows are scored and learned each; an empty
    table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size, end = src.agg(F.sum(F.octet_length("text")), F.sum((~F.col("held_out")).cast("long"))).first()
    n_blocks = max(1, -(-(size or 0) // BLOCK_BYTES))
    end = end or 0
    src = src.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int"))
    placed = src.select("block", "text", "held_out").repartition("block").sortWithinPartitions("block")
    stats = written(arrow_map(placed, block_counts, "block int, ctx int, keys binary, counts binary, word binary, n long"), "counts")
    words_in = stats.filter("word is not null").select("block", "word", "n")
    vocabulary = written(words_in.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = vocabulary.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + end, distinct + (end > 0)
    id_type = dict(src.dtypes)["id"]

    def rows(df: DataFrame, kind: int, **cols: str) -> DataFrame:
        every = {"ctx": "int", "data": "binary", "values": "binary", "n": "long", "id": id_type, "held_out": "boolean"}
        return df.select("block", F.lit(kind).alias("kind"), *((F.col(cols[k]) if k in cols else F.lit(None)).cast(t).alias(k) for k, t in every.items()))

    grams_known = rows(gram_values(stats.filter("ctx is not null"), n_blocks), 0, ctx="ctx", data="keys", values="values")
    words_known = rows(words_in.select("block", "word").join(vocabulary, "word"), 1, data="word", n="n")
    whole = grams_known.unionAll(words_known).unionAll(rows(src, 2, data="text", id="id", held_out="held_out"))
    placed = whole.repartition("block").sortWithinPartitions("block", "kind", "ctx")
    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    out = arrow_map(placed, lambda batches: scored(batches, total, distinct, end), schema)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / F.col("n_bytes") * F.lit(math.log2(10))).alias("bits_per_byte")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", bits)
