import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestar.llm import token_store as T

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello, world! It's we'll 'tis O'Neil's 12,345.67", "ÉCOLE naïve straße İstanbul ΣΑΣ Ÿ", "a\x1cb\x85c\xa0d e　f g",
    "<|endoftext|> x <|startoftext|>", "日本語 テキスト é 한국", "--- *** $$$ ### ''s 's't '' “quoted” — €5", "\x00\x1f\x7f", "x" * 3000, "ab " * 4000, "don’t…", "aȺb Ⱦx", "long text é " * 60_000,
]


def test_memo_encoder_matches_tokenizer(spark):
    tk, enc = Tokenizer.from_file(PATH), T.MemoEncoder(PATH)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40).collect()]
    for t in [x or "" for x in TEXTS] + docs + pages:
        assert np.frombuffer(enc.encode(t), dtype=enc.kind).tolist() == tk.encode(t, add_special_tokens=False).ids


def test_every_admitted_character_in_context():
    """Every character that may come to the memo, between letters, digits, marks and spaces: the tokenizer's ids."""
    tk, enc = Tokenizer.from_file(PATH), T.MemoEncoder(PATH)
    texts = [c.format(chr(k)) for k in range(0x20C0) if not 0xD800 <= k < 0xE000 for c in ("{}", "a{}b", "{}a", "1{}2", "'{}s", ".{}", "x {} y")]
    texts += [c.format(x) for x in "\u023a\u023e\u0130\u1e9e\u212a\u212b\u2126" for c in ("{}", "a{}b", "{}a", "{0}{0}é", "Z{}.")]
    for t, ids in zip(texts, tk.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.encode(t), dtype=enc.kind).tolist() == ids.ids, t


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_TEXT_BYTES", 9000)
    rows = [(100 - k, t) for k, t in enumerate(TEXTS * 2)] + [(100, "again"), (100, None)]
    store = T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH)
    tk, want, at = Tokenizer.from_file(PATH), [], 0
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(tk.encode(t or "", add_special_tokens=False).ids + [1])
    got = sorted(tuple(r) for r in store.read().collect())
    by_id = {}
    for i, start, n, crc in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
        by_id.setdefault(i, []).append((n, crc))
    want = {i: sorted((len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for x in xs) for i, xs in ids.items()}
    assert {i: sorted(x) for i, x in by_id.items()} == want
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted(i for i, _ in rows)
    again = T.TokenStore(spark, store.path)
    first = again.manifest().orderBy("k").first()
    assert again.dictionary == store.dictionary and first.before == 0 and again.manifest().count() > 1
    fs, name = T.open_fs(f"{store.path}/shard-{first.k:08d}.tok")
    with fs.open_input_file(name) as f:
        shard = T.Shard(f, store.dictionary, first.wide)
        k = int(shard.ids[0])
        assert sorted(x.tolist() for x in shard.find(k)) == sorted(ids[k])
    with fs.open_input_file(name) as f, pytest.raises(ValueError):
        T.Shard(f, b"other", first.wide)


def test_empty_table(spark):
    store = T.write_tokens(spark.createDataFrame([], "doc_id long, text string, n int, frame string"), PATH)
    assert store.read().collect() == []


def test_no_id_and_clashing_columns(spark):
    with pytest.raises(ValueError, match="no id"):
        T.write_tokens(spark.createDataFrame([(None, "a")], "doc_id long, text string"), PATH)
    df = spark.createDataFrame([(2, "a b", "x", 1, 2), (1, "c", "y", 3, 4)], "doc_id long, text string, t string, id int, h int")
    assert [(r.doc_id, r.start, r.n_tokens) for r in T.write_tokens(df, PATH).read().orderBy("doc_id").collect()] == [(1, 0, 2), (2, 2, 3)]


def test_parts_in_use_outlive_the_memory(monkeypatch):
    """Parts that every text holds are learned once, however many others fill the memory between."""
    monkeypatch.setattr(T, "MEMO", 150)
    tk, enc, learned = Tokenizer.from_file(PATH), T.MemoEncoder(PATH), []
    learn = enc.learn
    monkeypatch.setattr(enc, "learn", lambda parts: learned.extend(parts) or learn(parts))
    common = [f"{a}{b}o" for a in "bcdfg" for b in "aeiou"]
    for k in range(60):
        text = " ".join([*common, *(f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}zz" for a in "klmnpqrstv")])
        assert np.frombuffer(enc.encode(text), dtype=enc.kind).tolist() == tk.encode(text, add_special_tokens=False).ids
    assert sum(learned.count(w) for w in common) == len(common)


def test_texts_of_a_block(monkeypatch):
    """Texts for the memo and for the tokenizer side by side, in slices, with long parts; a distinct part is learned once and nothing for texts that go whole."""
    tk, enc, learned = Tokenizer.from_file(PATH), T.MemoEncoder(PATH), []
    learn = enc.learn
    monkeypatch.setattr(enc, "learn", lambda parts: learned.extend(parts) or learn(parts))
    texts = [x or "" for x in TEXTS] + ["alone 日", "Alone, ALONE's\x85alone\xa0(alone)", "", "\xa0", "\n\n", "İ alone", "é" * 300, "\x01\x7f a b"] * 2
    column = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    for col in (column, column.cast(pa.large_string())):
        got = [np.frombuffer(x, dtype=enc.kind).tolist() for x in enc.encode_all(col)]
        assert got == [x.ids for x in tk.encode_batch(texts, add_special_tokens=False)]
    assert learned.count("alone") == 1 and "naïve" not in learned and "before" not in learned and max(map(len, enc.memo)) <= T.LONGEST
    assert list(enc.encode_all(pa.array([], pa.string()))) == []


def test_blocks_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 2000)
    batches = [pa.record_batch({"id": list(range(k, k + n)), "t": ["x" * w] * n}, pa.schema({"id": pa.int64(), "t": pa.string()})) for k, n, w in ((0, 9, 9), (9, 0, 0), (9, 1, 5000), (10, 20, 30), (30, 20, 20))]
    blocks = list(T._blocks(iter(batches)))
    assert [i for b in blocks for i in b.column(0).to_pylist()] == list(range(50)) and [b.num_rows for b in blocks] == [9, 1, 40]
    assert list(T._blocks(iter([]))) == []
