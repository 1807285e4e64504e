import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chalktally.llm import queries, records, shared
from chalktally.llm.words import SMALL_PIECE_BYTES

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    found = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    return np.array([*found, 2], "<u4")


def expected(docs):
    start, out = 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = ids_of(text)
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def rows(df):
    return [tuple(r) for r in df.orderBy("start").select(
        "doc_id", "start", "n_tokens", "ids_crc32").collect()]


def test_query_equals_the_tokenizer_on_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows(queries.op7_token_id_records(spark, SF)) == expected(map(tuple, docs))


ODD = [
    (1, None), (2, ""), (3, "I'll DON'T it's o'clock"), (4, "a<|endoftext|>b <|startoftext|>"),
    (5, "É é ΣΑΣ İ ﬁ x y z"), (6, "12 3.5 abc123 --- _x_ a_b"), (7, "\x00\x01\n\n x"),
    (8, "日本語 のテキスト 👍🏽"), (9, "word," * 20_000), (10, "ß ÿ Ÿ µ ª ÷ a-b A.B, ok!!"), (10, "again"),
    (None, "no id"), (-5, "negative"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(*d, 1, "x") for d in ODD], "doc_id long, text string, shard int, frame string"
    )
    assert rows(records.encoded(df, PATH, 2)) == expected(ODD)


def test_shuffled_reads_and_damage(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    folder = shared.new_folder(spark, "test")
    records.write_records(df, folder, PATH, 2)
    index = records.read_index(spark, folder)
    got = records.read_at(spark, folder, index.where("doc_id % 2 = 0").orderBy(F.rand(3)))
    assert sorted(map(str, (r.ids for r in got.collect()))) == sorted(
        str(ids_of(t).tolist()) for i, t in ODD if i is not None and i % 2 == 0
    )
    data = records.frame(7, ids_of("good text"), 2)
    assert records.record_at(memoryview(data), 0)[0] == 7
    for i in (0, 9, 20, len(data) - 2):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            records.record_at(memoryview(bytes(broken)), 0)


def test_empty_table(spark):
    assert records.encoded(
        spark.createDataFrame([], "doc_id long, text string"), PATH, 2
    ).isEmpty()


def test_words_are_encoded_as_in_their_text():
    encoder = records.Encoder(PATH, 2)
    texts = ["Hello, WORLD!! ciónes", "ünï $$$ x--- the.### \t y", None]
    for got, text in zip(encoder.texts(pa.array(texts)), texts, strict=True):
        assert got.tolist() == ids_of(text).tolist()


class Counted:
    """An encoder's model or tokenizer that notes what it is given."""

    def __init__(self, of):
        self.of, self.given = of, []

    def tokenize(self, piece):
        self.given.append(piece)
        return self.of.tokenize(piece)

    def encode(self, word, **options):
        self.given.append(word)
        return self.of.encode(word, **options)


def test_pieces_met_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(records, "REMEMBERED", 4)
    encoder = records.Encoder(PATH, 2)
    model = encoder.model = Counted(encoder.model)
    whole = encoder.tokenizer = Counted(encoder.tokenizer)
    for i in range(6):
        text = f"Often often, it's {'abcdef'[i]}x"
        assert encoder.texts(pa.array([text]))[0].tolist() == ids_of(text).tolist()
    assert [model.given.count(p) for p in ("often", ",", "ax", "fx")] == [1, 1, 1, 1]
    assert whole.given == ["it's"]


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(records, "REMEMBERED", 4)
    encoder = records.Encoder(PATH, 2)
    texts = ["a b c d e f g h, i! j?", "long" * 26, "k a l m"]
    for _ in range(2):
        for text in texts:
            assert encoder.texts(pa.array([text]))[0].tolist() == ids_of(text).tolist()
            assert len(encoder.known) <= 4 and len(encoder.older) <= 4
            assert "long" * 26 not in encoder.known


def test_a_large_batch_is_encoded_in_small_pieces():
    docs = [(i, f"Word{i} and, others! " * 5000) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs, strict=True)], ["doc_id", "text"])
    made = list(records._frames(PATH, 2)(iter([batch])))
    longest = len(docs[-1][1])
    assert max(b.num_rows for b in made) * longest <= SMALL_PIECE_BYTES + longest
    got = [records.record_at(memoryview(f + b"\n"), 0)[:2] for b in made for f in b["frame"].to_pylist()]
    encoder = records.Encoder(PATH, 2)
    for (doc_id, ids), (i, text) in zip(got, docs, strict=True):
        assert doc_id == i and ids.tolist() == encoder.texts(pa.array([text]))[0].tolist()


def test_every_letter_and_sign():
    letters = [chr(c) for c in range(1, 0x250)]
    texts = [t for c in letters for t in (c, f"A{c}b {c}{c}. {c}!?", f"a,{c} É{c}́")]
    encoder = records.Encoder(PATH, 2)
    of = encoder.tokenizer.encode
    for text, got in zip(texts, encoder.texts(pa.array(texts)), strict=True):
        assert got.tolist() == [*of(text, add_special_tokens=False).ids, 2], ascii(text)
