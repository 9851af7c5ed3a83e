"""Benchmark decontamination with a positional inverted index.

The index is dealt by documents: each segment holds some documents and, for
each of their terms, the sorted word positions (postings). Every segment
answers a phrase by itself: starting with the list of its rarest term, lists
shifted by their offset in the phrase are intersected until all terms have been
met or nothing is left; for the windows of a benchmark all phrases go together. So no list of a frequent word is ever moved or gathered.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_map, new_path, small_batches, texts_of, written

#: Bytes of query text that are searched, and shipped to the executors, at once.
QUERY_BLOCK_BYTES = 8 << 20
#: Bytes of documents' texts in a segment of the index, about: what a worker, and a row on its way to a file, holds at once.
SEGMENT_BYTES = 1 << 20
#: Words are runs of 0-9, a-z and bytes above 127; A-Z are lower-cased.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SCHEMA = "segment long, doc_ids array<long>, doc_ends array<int>, terms array<binary>, list_ends array<int>, positions binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def tokenised(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for each text the number of words up to its end."""
    line = b" ".join([*texts, b""]).translate(_FOLD)
    a = np.frombuffer(line, dtype=np.uint8)
    word = np.concatenate([[False], a != 32, [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[word[1:-1]])])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(starts, bounds)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch (id, text) in parts of about SEGMENT_BYTES of text; a longer text is a part of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        below = int(size[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(size, below + SEGMENT_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of whole texts, as a written table of segments. Null texts have no words; repeated ids are documents of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, b in enumerate(x for whole in batches for x in slices(whole)):
            words, ends = tokenised(texts_of(b.column(1)))
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable").astype(np.uint32)
            lists = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
            row = [(part << 32) + n, b.column(0).to_pylist(), ends.astype(np.int32), coded.dictionary, lists.astype(np.int32), order.tobytes()]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
            cols = []
            for x, t in zip(row, types, strict=True):
                if pa.types.is_list(t):
                    v = x if isinstance(x, pa.Array) else pa.array(x, type=t.value_type)
                    cols.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
                else:
                    cols.append(pa.array([x], type=t))
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in _SCHEMA.split(", ")])

    out = arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")), run, _SCHEMA)
    path = new_path(docs.sparkSession, "index")
    small_batches(docs.sparkSession, 500)  # of texts: a JVM keeps several batches outside its heap
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


class Segment:
    """One segment of the index in memory."""

    def __init__(self, row: pa.RecordBatch, k: int):
        self.id = row.column(0)[k].as_py()
        self.doc_ids = row.column(1)[k].values
        self.doc_ends = row.column(2)[k].values.to_numpy()
        self.terms = row.column(3)[k].values
        self.ends = row.column(4)[k].values.to_numpy()
        self.positions = np.frombuffer(row.column(5)[k].as_py(), dtype=np.uint32).astype(np.int64)
        self.n_words = len(self.positions)

    def codes(self, terms: pa.Array) -> np.ndarray:
        """This segment's number of each term, -1 for terms that it lacks."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms.cast(terms.type)), -1).to_numpy()

    def postings(self, code: int) -> np.ndarray:
        return self.positions[self.ends[code - 1] if code else 0 : self.ends[code]]

    def term_at(self) -> np.ndarray:
        """The number of the term at each position, from the postings."""
        out = np.empty(self.n_words, dtype=np.int32)
        out[self.positions] = np.repeat(np.arange(len(self.ends), dtype=np.int32), np.diff(np.concatenate([[0], self.ends])))
        return out

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, position, "right")

    def phrase(self, codes: np.ndarray) -> np.ndarray:
        """Positions at which the terms follow each other within one document."""
        lists = [self.postings(c) for c in codes]
        by_length = sorted(range(len(codes)), key=lambda k: len(lists[k]))
        at = lists[by_length[0]] - by_length[0]
        for k in by_length[1:]:
            if len(at) == 0:
                return at
            found = np.searchsorted(lists[k], at + k)
            found[found == len(lists[k])] = 0
            at = at[lists[k][found] == at + k]
        at = at[(at >= 0) & (at + len(codes) <= self.n_words)]
        return at[self.doc_of(at) == self.doc_of(at + len(codes) - 1)]

    def near(self, codes: np.ndarray, within: int) -> list[tuple[int, int]]:
        """Smallest stretches (start, end) of at most ``within`` words of one document that hold all the terms."""
        need = sorted({int(c) for c in codes}, key=lambda c: len(self.postings(c)))
        rare = self.postings(need[0])
        spots = [(int(p), 0) for p in rare]
        for n, c in enumerate(need[1:], 1):
            p = self.postings(c)
            close = np.searchsorted(rare, p - within, "left") < np.searchsorted(rare, p + within, "right")
            spots += [(int(x), n) for x in p[close]]
        spots.sort()
        out, last = [], {}
        for p, n in spots:
            last[n] = p
            start = min(last.values())
            if len(last) == len(need) and p - start < within and self.doc_of(np.array([start]))[0] == self.doc_of(np.array([p]))[0]:
                if out and out[-1][0] == start:
                    continue
                out.append((start, p + 1))
        return out


class Windows:
    """The word windows of some query items, ready to be searched in segments: arrays of a bounded size, no object for each window."""

    #: Places that are tried at once.
    AT_ONCE = 1 << 19

    def __init__(self, items: Iterable[tuple[str, bytes]], size: int):
        names: list[str] = []
        sizes: list[int] = []
        texts: list[bytes] = []
        for item, text in items:
            texts.append(text)
            names.append(item)
        words, ends = tokenised(texts)
        coded = words.dictionary_encode()
        self.terms, flat = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
        sizes = np.diff(np.concatenate([[0], ends])).astype(np.int64)
        number = np.where(sizes > 0, np.maximum(1, sizes - size + 1), 0)
        owner = np.repeat(np.arange(len(names)), number)
        start = np.concatenate([[0], ends])[:-1][owner] + np.arange(len(owner)) - (np.cumsum(number) - number)[owner]
        length = np.minimum(size, sizes)[owner]
        at = start[:, None] + np.arange(size)
        rows = np.where(np.arange(size) < length[:, None], flat[np.minimum(at, max(0, len(flat) - 1))] if len(flat) else -1, -1).astype(np.int32)
        # Equal windows are one: sorted by all their terms, then told apart from the one before.
        order = np.lexsort(rows.T[::-1]) if len(rows) else np.zeros(0, dtype=np.int64)
        rows = rows[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, dtype=bool)
        self.rows, self.lengths = rows[new], length[order][new]
        window, item = np.cumsum(new) - 1, np.unique(np.array(names, dtype=object), return_inverse=True)
        self.names = item[0].tolist()
        pairs = np.unique(np.stack([window, item[1][owner[order]]], axis=1), axis=0) if len(rows) else np.zeros((0, 2), dtype=np.int64)
        self.item, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))

    def occurrences(self, seg: Segment) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and the places where they occur in a segment.

        All windows at once, some places at a time: the places of each one's
        rarest term, then those that the next rarest has at its offset, and so on.
        """
        if len(self.rows) == 0 or seg.n_words == 0:
            return
        own = seg.codes(self.terms)
        there = np.append(own >= 0, True)  # padding, the last, is always there
        some = np.flatnonzero(there[self.rows].all(axis=1))
        term_at = seg.term_at()
        counts = np.diff(np.concatenate([[0], seg.ends]))
        for s in range(0, len(some), 1 << 17):
            w = some[s : s + (1 << 17)]
            codes = np.append(own, -1)[self.rows[w]]
            often = np.where(codes >= 0, counts[codes], np.iinfo(np.int64).max)
            by_rarity = np.argsort(often, axis=1, kind="stable")
            rarest = codes[np.arange(len(w)), by_rarity[:, 0]]
            number = counts[rarest]
            turn = (np.cumsum(number) - number) // self.AT_ONCE
            for k in np.split(np.arange(len(w)), np.flatnonzero(np.diff(turn)) + 1):
                n = number[k]
                which = np.repeat(k, n)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = seg.positions[(seg.ends[rarest] - number)[which] + nth] - by_rarity[which, 0]
                fits = (at >= 0) & (at + self.lengths[w[which]] <= seg.n_words)
                which, at = which[fits], at[fits]
                for r in range(1, codes.shape[1]):
                    offset = by_rarity[which, r]
                    code = codes[which, offset]
                    keep = (code < 0) | (term_at[np.minimum(at + offset, seg.n_words - 1)] == code)
                    which, at = which[keep], at[keep]
                    if len(at) == 0:
                        break
                same = seg.doc_of(at) == seg.doc_of(at + self.lengths[w[which]] - 1)
                yield w[which[same]], at[same]

    def search(self, seg: Segment) -> tuple[np.ndarray, dict[int, set[str]]]:
        """For each word of the segment whether a window covers it; the items met in each document."""
        edge = np.zeros(seg.n_words + 1, dtype=np.int64)
        met: dict[int, set[str]] = defaultdict(set)
        for w, at in self.occurrences(seg):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + self.lengths[w], -1)
            n = self.first[w + 1] - self.first[w]
            doc, k = np.repeat(seg.doc_of(at), n), np.repeat(self.first[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            for d, i in np.unique(np.stack([doc, self.item[k]], axis=1), axis=0).tolist() if len(doc) else ():
                met[d].add(self.names[i])
        return np.cumsum(edge)[:-1] > 0, met


def overlaps(index: DataFrame, items: DataFrame, item_id: str = "item_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Rows (segment, ord, doc_id, n_words, spans, items) for every document of the index.

    spans: starts and ends, one after the other, of the runs of words that lie
    in an occurrence of a window of ``window`` words of an item (all words of a
    shorter item); items: the ids, as strings, of the items with such a window.
    The items are searched in blocks of at most QUERY_BLOCK_BYTES.
    """
    asked = items.select(F.col(item_id).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i is not null and t is not null")
    total = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = -(-total // QUERY_BLOCK_BYTES) or 1

    def run_of(windows: Windows, everything: bool):
        sent = index.sparkSession.sparkContext.broadcast(windows)  # the windows of QUERY_BLOCK_BYTES of text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    seg = Segment(b, k)
                    hit, met = sent.value.search(seg)
                    starts = np.concatenate([[0], seg.doc_ends[:-1]])
                    spans = []
                    for d, (s, e) in enumerate(zip(starts.tolist(), seg.doc_ends.tolist(), strict=True)):
                        if d not in met:
                            spans.append([])
                            continue
                        inner = np.flatnonzero(np.diff(np.concatenate([[0], hit[s:e].view(np.int8), [0]])))
                        spans.append(inner.tolist())
                    rows = np.arange(len(starts)) if everything else np.array(sorted(met), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), seg.id)),
                            pa.array(rows, pa.int32()),
                            seg.doc_ids.take(pa.array(rows)),
                            pa.array((seg.doc_ends - starts)[rows], pa.int64()),
                            pa.array([spans[d] for d in rows], pa.list_(pa.int32())),
                            pa.array([sorted(met.get(d, ())) for d in rows], pa.list_(pa.string())),
                        ],
                        names=["segment", "ord", "doc_id", "n_words", "spans", "items"],
                    )

        return run

    schema = "segment long, ord int, doc_id long, n_words long, spans array<int>, items array<string>"
    parts = []
    for n in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == n) if n_blocks > 1 else asked
        windows = Windows(((r.i, r.t.encode()) for r in rows.toLocalIterator()), window)
        part = arrow_map(index, run_of(windows, n == 0), schema)
        parts.append(written(part, "overlaps") if n_blocks > 1 else part)
    if n_blocks == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    merged = every.groupBy("segment", "ord").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("s"), F.flatten(F.collect_list("items")).alias("i"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, ids = [], []
            for lists, i in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                out: list[int] = []
                for s, e in sorted((x[k], x[k + 1]) for x in lists for k in range(0, len(x), 2)):
                    if out and s <= out[-1]:
                        out[-1] = max(out[-1], e)
                    else:
                        out += [s, e]
                spans.append(out)
                ids.append(sorted(set(i)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(spans, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))], names=["segment", "ord", "doc_id", "n_words", "spans", "items"])

    return arrow_map(merged, joined, schema)


def near_matches(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """Exact proximity matches: rows (doc_id, start, end) of the smallest stretches of at most ``within`` words with all the terms."""
    wanted = pa.array([w for t in terms for w in words_of(t.encode())], type=pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                seg = Segment(b, k)
                codes = seg.codes(wanted)
                found = seg.near(codes, within) if len(codes) and (codes >= 0).all() else []
                starts = np.array([s for s, _ in found], dtype=np.int64)
                docs = seg.doc_of(starts)
                base = np.concatenate([[0], seg.doc_ends])[docs]
                ends = np.array([e for _, e in found], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([seg.doc_ids.take(pa.array(docs)), pa.array(starts - base), pa.array(ends - base)], names=["doc_id", "start", "end"])

    return arrow_map(index, run, "doc_id long, start long, end long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one for each document.

    A word is hit if it lies in any occurrence of a window; a document is
    contaminated if some word is hit and ``share`` times the hit words are as
    many as all its words. Null and empty texts have no words and are clean;
    items without words or with a null id are never met; repeated items count
    once by their id; an empty benchmark leaves all documents clean; other
    columns are not read.
    """
    found = overlaps(build_index(docs), benchmark, window=window)
    starts, ends = F.expr("filter(spans, (x, i) -> i % 2 = 0)"), F.expr("filter(spans, (x, i) -> i % 2 = 1)")
    hit = F.aggregate(F.zip_with(starts, ends, lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def digest_of(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
