"""SimHash near-duplicates by pivot distance tables.

Each text gets a fingerprint of its word shingles. The Hamming distances of
every distinct fingerprint to ``PIVOTS`` reference fingerprints, whole and block
by block, form the pivot table. By the triangle inequality two fingerprints that
differ in at most ``radius`` bits have coordinates that differ by at most
``radius``. Fingerprints meet where the coordinates of some blocks are equal;
pairs with a larger difference in any whole coordinate are discarded, and the
survivors are verified by their exact distance.

A :class:`Scheme` says which blocks. :func:`exact`, 64 bits in five blocks that
meet in two, finds every pair within 3 bits. Candidates by a least similarity of
the shingles are in :mod:`lodestar.llm.similar`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_map, dealt_groups, local_labels, salted_join, scratch, texts_of, whole_groups, written
from lodestar.llm.components import components

#: Reference fingerprints of the pivot table.
PIVOTS = 16
#: Rows of a group that are compared with the whole group at once.
ROWS_AT_ONCE = 256
_LANES = np.uint64(0x0101010101010101)


@dataclass(frozen=True)
class Scheme:
    """Fingerprints of ``words`` 64-bit words that link within ``radius`` bits and meet where each block of a choice is equal."""

    words: int
    radius: int
    blocks: tuple[tuple[int, ...], ...]  #: each a mask, word by word
    choices: tuple[tuple[int, ...], ...]
    pivots: int = PIVOTS  #: whose distances discard pairs
    ratio: Fraction | None = None  #: of the sizes ``n`` of two rows, at least


def _mask(bits: range, words: int) -> tuple[int, ...]:
    out = [0] * words
    for b in bits:
        out[b // 64] |= 1 << (b % 64)
    return tuple(out)


def exact(radius: int = 3) -> Scheme:
    """64 bits in five blocks: of pairs within ``radius`` (0 to 4) bits, 5 - radius blocks are equal, so all of them meet."""
    if not 0 <= radius < 5:
        raise ValueError("radius must be 0 to 4")
    ends = (0, 13, 26, 39, 52, 64)
    return Scheme(1, radius, tuple(_mask(range(a, b), 1) for a, b in zip(ends, ends[1:], strict=False)), tuple(combinations(range(5), 5 - radius)))


def references(words: int = 1, n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: hashes of their numbers."""
    return np.array([[xxhash.xxh64_intdigest(b"pivot %d" % i, 42 + w) for w in range(words)] for i in range(n)], dtype=np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words joined by spaces; of all words where there are fewer."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(line, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    first = [0, *(ends[: len(words) - size] + 1).tolist()]
    return np.array([h(line[a:b], 42) for a, b in zip(first, ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For one hash or more of some words each (words by hashes): in how many each bit is set (words by 64)."""
    words, n = hashes.shape
    starts = np.arange(0, n, 255)
    counts = np.empty((words, 8, 8), dtype=np.int64)  # of bit k in byte b
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts, axis=1)  # up to 255 in each byte
        counts[:, :, k] = lanes.view(np.uint8).reshape(words, -1, 8).sum(axis=1, dtype=np.int64)
    return counts.reshape(words, 64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; 0 for none."""
    if len(hashes) == 0:
        return 0
    set_ = 2 * bit_counts(hashes[None])[0] > len(hashes)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hashes, and what a multiplicative mixer makes of them for each further word (words by hashes)."""
    x = np.broadcast_to(hashes, (words, len(hashes))) + (np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    x[1:] *= np.uint64(0xBF58476D1CE4E5B9)
    x[1:] ^= x[1:] >> np.uint64(31)
    x[1:] *= np.uint64(0x94D049BB133111EB)
    x[1:] ^= x[1:] >> np.uint64(29)
    return x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fp binary) of whole texts: the fingerprint, little-endian; null and empty texts get zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [majority(shingle_hashes(words_of(t), shingle)).to_bytes(8, "little") for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], names=["id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")), run, "id long, fp binary")


def as_words(column: pa.Array, words: int) -> np.ndarray:
    """Fingerprints of a binary column, a row of words each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    start = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", dtype="<u8", count=len(column) * words, offset=int(start)).reshape(-1, words) if len(column) else np.empty((0, words), dtype="<u8")


def meeting_keys(fps: np.ndarray, scheme: Scheme) -> np.ndarray:
    """One row of keys for each fingerprint: hashes of the pivot coordinates of each choice of blocks."""
    refs, hashed = references(scheme.words), []
    for block in scheme.blocks:
        key = np.zeros(len(fps), dtype=np.uint64)
        held = [w for w in range(scheme.words) if block[w]]
        for r in refs:
            key = key * np.uint64(31) + sum(np.bitwise_count((fps[:, w] ^ r[w]) & np.uint64(block[w])).astype(np.uint64) for w in held)
        hashed.append(key)
    keys = []
    for n, chosen in enumerate(scheme.choices):
        key = np.full(len(fps), n + 1, dtype=np.uint64)
        for c in chosen:
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashed[c]
        keys.append(key ^ (key >> np.uint64(32)))
    return np.stack(keys, axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def surviving(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within ``radius``: first by the largest coordinate difference, then verified."""
    for c in range(table.shape[1]):
        if len(i) == 0:
            break
        keep = np.abs(table[i, c] - table[j, c]) <= radius
        i, j = i[keep], j[keep]
    keep = distances(fps[i], fps[j]) <= radius
    return i[keep], j[keep]


def group_links(batches: Iterator[pa.RecordBatch], scheme: Scheme, small: int = 256) -> Iterator[pa.RecordBatch]:
    """For each turn of a meeting key, links from each fingerprint to the smallest one it reaches in that turn.

    Turns of up to ``small`` rows are gone through all at once, pair distance by pair distance of their places.
    """
    refs, radius = references(scheme.words, scheme.pivots), scheme.radius
    for t, starts in whole_groups(batches, ["key", "lo", "hi"]):
        fps = as_words(t.column("fp"), scheme.words)
        rep = t.column("rep").combine_chunks().to_numpy()
        side = t.column("side").combine_chunks().to_numpy()
        one = t.column("lo").combine_chunks().to_numpy() == t.column("hi").combine_chunks().to_numpy()
        count = t.column("n").combine_chunks().to_numpy().astype(np.int64) if scheme.ratio else None
        table = np.stack([distances(fps, r) for r in refs], axis=1)

        def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if scheme.ratio:
                x, y = count[i], count[j]  # noqa: B023
                keep = scheme.ratio.denominator * np.minimum(x, y) >= scheme.ratio.numerator * np.maximum(x, y)
                i, j = i[keep], j[keep]
            return surviving(fps, table, i, j, radius)  # noqa: B023

        n = len(fps)
        sizes = np.diff(np.append(starts, n))
        group = np.repeat(np.arange(len(starts)), sizes)
        found = []
        at = np.flatnonzero(sizes[group] <= small)
        for k in range(1, int(sizes[sizes <= small].max(initial=0))):
            at = at[at + k < n]
            at = at[group[at] == group[at + k]]
            if len(at) == 0:
                break
            i, j = at, at + k
            meet = one[i] | (side[i] != side[j])
            found.append(kept(i[meet], j[meet]))
        label = local_labels(n, *(np.concatenate(x) for x in zip(*found, strict=True))) if found else np.arange(n)
        for g in np.flatnonzero(sizes > small):
            a, b = starts[g], starts[g] + sizes[g]
            left = np.arange(a, b) if one[a] else a + np.flatnonzero(side[a:b] == 0)
            right = left if one[a] else a + np.flatnonzero(side[a:b] == 1)
            right = right[np.argsort(table[right, 0], kind="stable")]
            coordinate = table[right, 0]
            own = np.arange(b - a)
            for s in range(0, len(left), ROWS_AT_ONCE):
                rows = left[s : s + ROWS_AT_ONCE]
                lo, hi = np.searchsorted(coordinate, table[rows, 0] - radius, "left"), np.searchsorted(coordinate, table[rows, 0] + radius, "right")
                i = np.repeat(rows, hi - lo)
                j = right[np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)])] if len(i) else i
                apart = own[i - a] != own[j - a]
                i, j = kept(i[apart], j[apart])
                if len(i):
                    own = local_labels(b - a, np.concatenate([np.arange(b - a), i - a]), np.concatenate([own, j - a]))
            label[a:b] = a + own
        linked = rep[label] != rep
        yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label][linked])], names=["u", "v"])


def near_links(reps: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (u, v) between the ids ``rep`` of distinct fingerprints ``fp``, enough for the components of all pairs that meet and are within the radius."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = meeting_keys(as_words(b.column(0), scheme.words), scheme).view(np.int64)
            at = pa.array(np.repeat(np.arange(len(k)), k.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), b.column(0).take(at), b.column(1).take(at)], names=["key", "fp", "rep"])

    met = arrow_map(reps.select("fp", "rep"), keys, "key long, fp binary, rep long")
    return arrow_map(dealt_groups(met, "key", F.col("fp")), lambda x: group_links(x, scheme), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, scheme: Scheme | None = None) -> DataFrame:
    """Rows (id_col, fingerprint, component_id): fingerprint as hex digits, 16 for each word, component_id the smallest id
    reachable by links of the scheme, by default at most 3 differing bits.

    Null and empty texts have fingerprint zero and link like any other; repeated
    ids give a row each; ids must not be null (such rows get a null component
    unless an equal fingerprint has an id); an empty table gives no rows; other
    columns are not read.
    """
    scheme = scheme or exact(3)
    with scratch() as keep:
        fps = keep(written(fingerprints(docs, id_col, text_col, shingle), "fingerprints"))
        reps = written(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "reps")
        comps = components(near_links(reps.filter("rep is not null"), scheme), few=True)
        ends = reps.join(comps, reps.rep == comps.node, "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
        ends = keep(written(ends, "ends"))
    out = salted_join(fps, ends, "fp", "n", F.col("id"))
    return out.select(F.col("id").alias(id_col), _hex_words("fp", scheme.words).alias("fingerprint"), "component_id")


def _hex_words(col: str, words: int):
    """The words of a fingerprint, most significant byte first, as lowercase hex digits."""
    hexed = F.hex(col)
    return F.lower(F.concat(*(F.substring(hexed, 16 * w + 2 * b + 1, 2) for w in range(words) for b in range(7, -1, -1))))
