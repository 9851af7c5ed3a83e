"""Token ids in binary shards compressed with one shared zstandard dictionary.

A store is a folder: ``dictionary`` (the zstandard dictionary, trained on
serialised id arrays) and shard files in ascending order of document id. A shard
is a header, the compressed frames, one for each document, and an index of
(document id, frame offset, token count) with the SHA-256 of the dictionary, so
that a short document is read by its own few bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm.common import arrow_map, dropped, new_path, open_fs, put, written

MAGIC = b"LODTOK1\n"
#: Bytes of the trailer: frame count, index position, dictionary hash, magic.
_TRAILER = 8 + 8 + 32 + len(MAGIC)
#: Documents, and bytes of their text, of the sample on which the dictionary is trained.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 8 << 20
DICTIONARY_BYTES = 64 << 10
#: Text bytes that go to one shard.
SHARD_TEXT_BYTES = 64 << 20
#: Word parts in each of a worker's two generations of memory, and characters of the longest that is remembered.
MEMO, LONGEST = 250_000, 100
#: Text bytes that a worker encodes at once.
BLOCK_BYTES = 8 << 20


def _class_of(chars: Iterable[str]) -> str:
    """Characters as the ranges of a character class."""
    codes = np.array(sorted(map(ord, chars)))
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
    return "".join(f"\\x{{{r[0]:x}}}-\\x{{{r[-1]:x}}}" for r in runs)


class MemoEncoder:
    """The tokenizer's ids as little-endian unsigned integers, of 16 bits where all ids fit (``kind``).

    Texts of Latin letters and common punctuation are taken many at once: their
    distinct stretches between white space are lower-cased and split into the parts
    between which the tokenizer never merges, the tokenizer's model gives the ids of
    each distinct part, and these are laid out by the places of parts and stretches.
    All other texts go to the tokenizer whole. Parts are remembered; what was not met
    during a generation of the memory is forgotten.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.wide = max(vocab.values(), default=0) > 65535
        self.kind = "<u4" if self.wide else "<u2"
        # Characters that the normalizer changes, but for their lower case, are not among these.
        spans = ((0, 0x1C), (0x20, 0x250), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0))
        admitted = [chr(k) for a, b in spans for k in range(a, b)]
        lower = pc.utf8_lower(pa.array(admitted)).to_pylist()
        plain = [c for c, low in zip(admitted, lower, strict=True) if c.lower() == low and low in admitted]
        self.odd = f"[^{_class_of(plain)}]|<\\|"
        letter, number, space = (_class_of(c for c in plain if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
        # The split pattern of word_bpe_49k.json (fixed values), written for these characters.
        self.parts = f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{space}{letter}{number}]+"
        self.no_letter, self.space = f"[^{letter}]", f"[{space}]"
        self.signs = _byte_signs() | {10: "\n"}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        spec = repr(self.tokenizer.pre_tokenizer)
        self.known = "Split" in spec and "ByteLevel" in spec and "'ll|'d" in spec

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def learn(self, parts: list[str]) -> list[bytes]:
        """The ids of parts written in the signs of bytes, by the tokenizer's model."""
        tokenize = self.tokenizer.model.tokenize
        ids: list[int] = []
        ends = [0]
        for p in parts:
            ids += [t.id for t in tokenize(p)]
            ends.append(len(ids))
        data = np.array(ids, dtype=self.kind).tobytes()
        each = np.dtype(self.kind).itemsize
        return [data[each * a : each * b] for a, b in zip(ends, ends[1:], strict=False)]

    def ids_of(self, parts: pa.Array) -> pa.Array:
        """The ids of each distinct part in lower case, remembered or learned."""
        if not len(parts):
            return pa.array([], pa.large_binary())
        if len(self.memo) > MEMO:
            self.memo, self.old = {}, self.memo
        # No part holds a line end.
        names = "\n".join(parts.to_numpy(zero_copy_only=False)).encode().decode("latin-1").translate(self.signs).split("\n")
        found = list(map(self.memo.get, names))
        new = []
        for k, x in enumerate(found):
            if x is None:
                if (x := self.old.get(names[k])) is None:
                    new.append(k)
                else:
                    found[k] = self.memo[names[k]] = x
        for k, x in zip(new, self.learn([names[k] for k in new]), strict=True):
            found[k] = x
            if len(names[k]) <= LONGEST:
                self.memo[names[k]] = x
        return pa.array(found, pa.large_binary())

    def stretches(self, words: pa.Array) -> pa.Array:
        """The ids of each plain stretch: of its parts, one after another."""
        low = pc.utf8_lower(words)
        mixed = pc.match_substring_regex(low, self.no_letter)
        some = pc.replace_substring_regex(pc.replace_substring_regex(low.filter(mixed), self.space, " "), self.parts, r"\0 ")
        parts, bounds = _split(pc.replace_with_mask(low, mixed, some))
        return _joined(self.ids_of(parts.dictionary).take(parts.indices), bounds)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (no nulls)."""
        if not self.known:
            yield from map(self.whole, texts.to_pylist())
            return
        if texts.nbytes > 1 << 28:  # offsets of 32 bits may not do for what is made of them
            texts = texts.cast(pa.large_string())
        coded, bounds = _split(texts)
        words = coded.dictionary
        odd = pc.match_substring_regex(words, self.odd).to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), dtype=bool)
        if odd.any():  # nothing is learned for texts that go whole
            places = coded.indices.to_numpy()
            whole = np.diff(np.concatenate([[0], np.cumsum(odd[places])])[bounds]) > 0
            used = np.zeros(len(words), dtype=bool)
            used[places[np.repeat(~whole, np.diff(bounds))]] = True
            words = pc.if_else(pa.array(used), words, pa.scalar("", words.type))
        laid = _joined(self.stretches(words).take(coded.indices), bounds)
        for k, is_whole in enumerate(whole.tolist()):
            yield self.whole(texts[k].as_py()) if is_whole else laid[k].as_py()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))


def _byte_signs() -> dict[int, str]:
    """The sign by which a byte-level model writes each byte: itself where it prints, else one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + k) for k, b in enumerate(others)}


def _split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The stretches of all texts between ASCII white space, by a dictionary, and where each text's begin and end."""
    lists = pc.ascii_split_whitespace(texts)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)])
    return lists.flatten().dictionary_encode(), bounds


def _joined(pieces: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Runs of pieces (large binaries, no nulls) as one value each, without a copy."""
    ends = np.frombuffer(pieces.buffers()[1], dtype=np.int64)[pieces.offset : pieces.offset + len(pieces) + 1][bounds]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pieces.buffers()[2]])


@lru_cache(maxsize=1)
def encoder(path: str) -> MemoEncoder:
    """A worker's encoder, kept with what it remembers from one task to the next."""
    return MemoEncoder(path)


def texts_and_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))


def train_dictionary(src: DataFrame, n: int, size: int, tokenizer: str, end_id: int) -> bytes:
    """The shared dictionary, from a sample of about SAMPLE_DOCS of n documents and SAMPLE_BYTES of ``size`` bytes chosen by the hash of the id."""
    if not n:
        return b""
    share = min(1.0, SAMPLE_DOCS / n, SAMPLE_BYTES / max(1, size))
    picked = src.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    samples = [r.b for r in encoded(picked, tokenizer, end_id, None, framed=False).select(F.col("frame").alias("b")).toLocalIterator()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary themselves
        return b"".join(samples)[-DICTIONARY_BYTES:]


def codec(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BLOCK_BYTES."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and sum(h.nbytes for h in held) + b.nbytes > BLOCK_BYTES:
            yield pa.concat_batches(held)
            held = []
        held.append(b)
    if held:
        yield pa.concat_batches(held)


def encoded(src: DataFrame, tokenizer: str, end_id: int, dictionary: bytes | None, framed: bool = True) -> DataFrame:
    """Rows (id, n, frame): the token count and the compressed (or plain) serialised ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.kind).tobytes()
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=codec(dictionary or b"")).compress if framed else bytes
        for b in _blocks(batches):
            counts, frames = [], []
            for ids in enc.encode_all(b.column(1)):
                ids += end
                counts.append(len(ids) // len(end))
                frames.append(squeeze(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32()), pa.array(frames, pa.binary())], names=["id", "n", "frame"])

    return arrow_map(src, run, "id long, n int, frame binary")


def pack_shard(ids: np.ndarray, counts: np.ndarray, frames: list[bytes], dictionary: bytes) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<i8") + len(MAGIC)
    body = MAGIC + b"".join(frames)
    index = ids.astype("<i8").tobytes() + offsets.tobytes() + counts.astype("<i4").tobytes()
    return body + index + np.array([len(frames), len(body)], dtype="<i8").tobytes() + hashlib.sha256(dictionary).digest() + MAGIC


class Shard:
    """A shard file opened for reading by document."""

    def __init__(self, file: pa.NativeFile, dictionary: bytes, wide: bool):
        self.file, self.wide = file, wide
        size = file.size()
        tail = file.read_at(_TRAILER, size - _TRAILER)
        if tail[-len(MAGIC) :] != MAGIC or tail[16:48] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token shard of this dictionary")
        n, at = np.frombuffer(tail[:16], dtype="<i8")
        index = file.read_at(size - _TRAILER - at, at)
        self.ids = np.frombuffer(index[: 8 * n], dtype="<i8")
        self.offsets = np.frombuffer(index[8 * n : 8 * (2 * n + 1)], dtype="<i8")
        self.counts = np.frombuffer(index[8 * (2 * n + 1) :], dtype="<i4")
        self.unpack = zstandard.ZstdDecompressor(dict_data=codec(dictionary)).decompress

    def tokens(self, k: int) -> np.ndarray:
        """The ids of the k-th document as unsigned 32-bit integers."""
        frame = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        out = np.frombuffer(self.unpack(frame), dtype="<u4" if self.wide else "<u2").astype("<u4")
        if len(out) != self.counts[k]:
            raise ValueError("a frame does not hold the tokens of its index")
        return out

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all documents with this id."""
        a, b = np.searchsorted(self.ids, [doc_id, doc_id + 1])
        return [self.tokens(k) for k in range(a, b)]


class TokenStore:
    """A written store: a folder with the dictionary, the shards, and a table ``manifest`` of them (k, docs, tokens, wide)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        fs, name = open_fs(f"{path}/dictionary")
        with fs.open_input_file(name) as f:
            self.dictionary = f.read()

    def manifest(self) -> DataFrame:
        """Rows (k, docs, tokens, wide, before), one for each shard; ``before``: ids in the shards before it."""
        rows = self.spark.read.schema("k long, docs long, tokens long, wide boolean").parquet(f"{self.path}/manifest")
        earlier = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
        return rows.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))

    def read(self) -> DataFrame:
        """Rows (doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
        path, dictionary = self.path, self.dictionary

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, wide, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    fs, name = open_fs(f"{path}/shard-{k:08d}.tok")
                    with fs.open_input_file(name) as f:
                        shard = Shard(f, dictionary, wide)
                        crc = [zlib.crc32(shard.tokens(i).tobytes()) for i in range(len(shard.ids))]
                        start = before + np.concatenate([[0], np.cumsum(shard.counts.astype(np.int64))[:-1]])
                        yield pa.RecordBatch.from_arrays([pa.array(shard.ids), pa.array(start), pa.array(shard.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        shards = self.manifest().select("k", "wide", "before")
        return arrow_map(shards.repartition(max(1, shards.count())), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> TokenStore:
    """Encode every whole text, append ``end_id`` and write the store, shards and documents in ascending order of id.

    Null texts are empty and hold the end id only; repeated ids are documents
    of their own, in the order of the hash of their bytes; rows without an id are
    an error; an empty table gives a store without shards; other columns are not
    read. The tokenizer's file must be at ``tokenizer`` on every executor.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    wide = MemoEncoder(tokenizer).wide
    src = texts_and_ids(docs, id_col, text_col)
    n, size, none = src.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count_if(F.col("id").isNull())).first()
    if none:
        raise ValueError("a document has no id")
    dictionary = train_dictionary(src, n, size, tokenizer, end_id)
    put(f"{path}/dictionary", dictionary)
    rows = written(encoded(src, tokenizer, end_id, dictionary), "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            k, counts = TaskContext.get().partitionId(), t.column("n").to_numpy()
            put(f"{path}/shard-{k:08d}.tok", pack_shard(t.column("id").to_numpy(), counts, t.column("frame").to_pylist(), dictionary))
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t.num_rows]), pa.array([int(counts.sum())]), pa.array([wide])], names=["k", "docs", "tokens", "wide"])

    # The bounds of the ranges are sampled from the id and a hash: no frame goes to the driver.
    keyed = rows.withColumn("h", F.xxhash64("frame"))
    dealt = keyed.repartitionByRange(max(1, -(-size // SHARD_TEXT_BYTES)), "id", "h").sortWithinPartitions("id", "h", "frame").drop("h")
    arrow_map(dealt, run, "k long, docs long, tokens long, wide boolean").write.parquet(f"{path}/manifest")
    dropped(rows)
    return TokenStore(spark, path)
