import zlib

import numpy as np
import pyarrow as pa
import pytest

from chalktally.llm import language_id, queries

SF = "/root/testdata/sf0.01"
EN = "the cat and the dog were in the house with a friend of the king "
FR = "le chat et le chien dans la maison avec un ami du roi que voici "


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op9_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    right = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.held_out:
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert total > 150 and right >= 0.95 * total


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    evidence, transitions = rng.standard_normal((4, 2, 3)), rng.standard_normal((3, 3))
    lengths = np.array([4, 2])
    got, _ = language_id.forward_backward(evidence, lengths, transitions)
    for text, size in enumerate(lengths):
        total = np.zeros((size, 3))
        for path in np.ndindex(*[3] * size):
            weight = np.exp(
                sum(evidence[t, text, y] for t, y in enumerate(path))
                + sum(transitions[a, b] for a, b in zip(path[:-1], path[1:], strict=True))
            )
            for t, y in enumerate(path):
                total[t, y] += weight
        assert got[:size, text] == pytest.approx(total / total.sum(1, keepdims=True))


def test_words_of_mixed_text():
    model = language_id.learn([EN * 20, FR * 20] * 10, ["en", "fr"] * 10)
    text = "the dog and the king 12 !! le chien et la maison"
    chances, starts, letters = language_id.word_languages(model, pa.array([text]))
    named = [model.languages[i] for i in chances.argmax(1)]
    assert named[:5] == ["en"] * 5 and named[7:] == ["fr"] * 5
    assert letters.tolist() == [True] * 5 + [False] * 2 + [True] * 5


def test_odd_rows(spark):
    texts = [EN, FR, None, "", "123 !!", EN * 3000, "Ä", "\t\n", EN]
    docs = [(i, t, "en" if i % 2 else "fr", 1, "x") for i, t in enumerate(texts)]
    docs += [(100 + i, EN, "en", 1, "x") for i in range(8)] + [(200 + i, FR, "fr", 1, "x") for i in range(8)]
    docs += [(300, EN, None, 1, "x"), (None, FR, "fr", 1, "x"), (100, FR, "fr", 1, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score int, lang_pred string")
    got = [r for r in language_id.language(df).collect() if r.doc_id is not None and r.doc_id < 9]
    named = {r.doc_id: r.lang_pred for r in got}
    assert [named[i] for i in (2, 3, 4, 7)] == ["und"] * 4
    assert named[5] == "en" and named[6] in ("en", "fr")
    assert language_id.language(df.limit(0)).isEmpty()


def test_no_language_known(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert language_id.language(df).first().lang_pred == "und"


def test_short_texts_and_scripts_without_blanks_are_learned(spark):
    zh = ["我们今天在学校里读书", "他昨天去了北京的图书馆", "这本书是我的朋友写的", "天气很好我们去公园"]
    rows = [(i, EN * 3, "en") for i in range(40)]
    rows += [(100 + i, ("maison avec le", "chat dans un", "roi que voici")[i % 3], "fr") for i in range(40)]
    rows += [(200 + i, zh[i % 4], "zh") for i in range(40)]
    rows += [(300, "þetta er", "is"), (301, "þetta er", "is"), (302, "þetta er", "is")]
    rows += [(900, "le roi avec un chat", None), (901, "我的朋友今天去图书馆", None), (902, "the king", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    named = {r.doc_id: r.lang_pred for r in language_id.language(df).collect()}
    assert [named[i] for i in (900, 901, 902, 300)] == ["fr", "zh", "en", "is"]


def test_pooled_keeps_every_word():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 3, 25, 9, 10, 1, 7, 0, 400, 2])
    label = np.array([0, 1, 0, 1, 1, 2, 0, 2, 2, 3])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = rng.integers(0, 50, starts[-1])
    got, at, marks = language_id._pooled(codes, starts, label, 10)
    assert (np.diff(at) >= 10).all() and len(marks) == len(at) - 1 and at[-1] == len(got)
    for j in range(4):
        had = [codes[starts[i] : starts[i + 1]] for i in np.flatnonzero(label == j)]
        has = [got[at[i] : at[i + 1]] for i in np.flatnonzero(marks == j)]
        assert set(np.concatenate(had)) == set(np.concatenate(has))


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rows = [(i, EN, f"l{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2"):
        language_id.language(df)


def test_learning_rows_are_the_first_by_hash(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LEARN_ROWS", 3)
    rows = [(i, f"{EN} {i}", "en" if i % 3 else "fr") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.lang, r.text) for r in language_id.learning_rows(df, 5).collect()]
    hashes = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(doc_id, text) h").collect()}
    want = []
    for name in ("en", "fr"):
        some = [r for r in rows if r[2] == name and zlib.crc32(str(r[0]).encode()) % 5]
        want += [(name, r[1]) for r in sorted(some, key=lambda r: hashes[r[0]])[:3]]
    assert got == want
