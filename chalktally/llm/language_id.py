"""Language of each word by a linear-chain conditional random field.

A word's evidence is the sum of the weights of its features: its affixes and
byte n-grams, hashed, and its entry in a lexicon of frequent words. Weights and
the transitions between the languages of neighbouring words are learned by
maximum likelihood. Texts in which languages are mixed aren't labelled word by
word, so learning sequences are put together from stretches of texts of known
languages, which shows the transitions. Forward-backward gives every word of a
whole text the probability of each language; a document has the language with
the largest sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalktally.llm import shared
from chalktally.llm.words import affixed_ngrams, pieces, words

GRAMS, BUCKETS = (1, 2, 3, 4), 1 << 15
LEXICON = 10_000
#: Documents that are learned from per language, picked by a hash of their id.
LEARN_ROWS = 500
#: More languages than this are a mistake in the column; ``fit`` then raises ValueError.
MOST_LANGUAGES = 1000
SEQUENCE, EPOCHS, BATCH, RATE = 40, 3, 64, 0.5
#: Stretches that a text of that many or more gives to an epoch.
STRETCHES = 12
UNKNOWN = "und"
_SIGNS = ".,;:!?*#%&$\"'()[]{}|<>=+-_/\\~^`0123456789@"


@dataclass
class Model:
    languages: list[str]
    lexicon: list[str]
    weights: np.ndarray  # (BUCKETS + lexicon + 1, languages), the last row zero
    transitions: np.ndarray  # log potentials (from, to)

    def features(self, dictionary: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features of all distinct words in a row, the word of each, whether a
        word has a letter)."""
        plain = pc.utf8_trim(pc.utf8_lower(dictionary), characters=_SIGNS)
        hashes, owner = affixed_ngrams(plain, GRAMS, seed=1)
        ids = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        place = pc.index_in(plain, value_set=pa.array(self.lexicon, pa.string()))
        place = pc.fill_null(place, len(self.lexicon)).to_numpy(zero_copy_only=False)
        letters = pc.match_substring_regex(plain, r"\p{L}").to_numpy(zero_copy_only=False)
        return (
            np.concatenate([ids, BUCKETS + place]),
            np.concatenate([owner, np.arange(len(plain))]),
            letters.astype(bool),
        )

    def evidence(self, dictionary: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(word, language) sums of weights, nothing for a word without letters,
        and whether a word has a letter."""
        n, k = len(dictionary), len(self.languages)
        if not n:
            return np.zeros((0, k)), np.zeros(0, bool)
        ids, owner, letters = self.features(dictionary)
        sums = np.stack(
            [np.bincount(owner, self.weights[ids, j], minlength=n) for j in range(k)], axis=1
        )
        return np.where(letters[:, None], sums, 0.0), letters


def forward_backward(
    evidence: np.ndarray, lengths: np.ndarray, transitions: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (place, text, language), and the messages they come from, of
    chains padded to the longest; ``evidence`` is (place, text, language) and
    places from a text's length on are ignored. Messages are scaled to sum 1."""
    size, n, k = evidence.shape
    local = np.exp(evidence - evidence.max(2, keepdims=True))
    step = np.exp(transitions)
    ahead, behind = np.empty((size, n, k)), np.ones((size, n, k))
    for t in range(size):
        m = local[t] if t == 0 else (ahead[t - 1] @ step) * local[t]
        ahead[t] = m / m.sum(1, keepdims=True)
    for t in range(size - 2, -1, -1):
        m = (local[t + 1] * behind[t + 1]) @ step.T
        m = m / m.sum(1, keepdims=True)
        behind[t] = np.where((t + 1 < lengths)[:, None], m, 1.0)
    both = ahead * behind
    return both / both.sum(2, keepdims=True), behind


def _pair_sums(marginals, behind, evidence, transitions) -> np.ndarray:
    """Expected number of (from, to) pairs over all chains of full length."""
    local = np.exp(evidence - evidence.max(2, keepdims=True))
    ahead = marginals / behind
    ahead = ahead / ahead.sum(2, keepdims=True)
    joint = ahead[:-1, :, :, None] * np.exp(transitions) * (local * behind)[1:, :, None, :]
    return (joint / joint.sum((2, 3), keepdims=True)).sum((0, 1))


def _pooled(codes, starts, label, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, label) in which texts of fewer than ``stretch`` words stand in
    rows with others of their language, as texts behind the longer ones. A language
    that has fewer words than that altogether repeats them."""
    lengths = np.diff(starts)
    short = lengths < stretch
    rows = [codes[starts[i] : starts[i + 1]] for i in np.flatnonzero(~short)]
    marks = label[~short].tolist()
    for j in np.unique(label[short & (lengths > 0)]):
        pool = np.concatenate(
            [codes[starts[i] : starts[i + 1]] for i in np.flatnonzero(short & (label == j))]
        )
        pool = np.tile(pool, -(-stretch // len(pool)))
        cut = np.array_split(pool, max(1, len(pool) // (STRETCHES * stretch)))
        rows += cut
        marks += [j] * len(cut)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    return np.concatenate([codes[:0], *rows]), starts, np.array(marks, np.int64)


def learn(texts: list[str], languages: list[str], seed: int = 7) -> Model:
    """Fit to whole texts of known languages by stochastic gradients with steps
    that shrink per weight. Short texts of one language are learned from together,
    so a language of short texts, or one written without blanks, is learned too."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages], np.int64)
    k = len(names)
    codes, starts, dictionary = words(pa.array(texts, pa.string()))
    plain = pc.utf8_trim(pc.utf8_lower(dictionary), characters=_SIGNS)
    counts = np.bincount(codes, minlength=len(dictionary))
    coded = plain.dictionary_encode()
    uses = np.bincount(
        coded.indices.to_numpy(zero_copy_only=False), counts, minlength=len(coded.dictionary)
    )
    often = np.argsort(-uses, kind="stable")[:LEXICON]
    lexicon = coded.dictionary.take(pa.array(often[uses[often] >= 3])).to_pylist()
    model = Model(names, lexicon, np.zeros((BUCKETS + len(lexicon) + 1, k)), np.zeros((k, k)))
    if k < 2:
        return model
    ids, owner, letters = model.features(dictionary)
    order = np.argsort(owner, kind="stable")
    ids, bounds = ids[order], np.searchsorted(owner[order], np.arange(len(dictionary) + 1))
    rng = np.random.default_rng(seed)
    # Stretches of ten words of known language, from all over each text.
    stretch = SEQUENCE // 4
    codes, starts, label = _pooled(codes, starts, label, stretch)
    sizes = np.diff(starts) // stretch
    text = np.repeat(np.arange(len(sizes)), np.minimum(sizes, STRETCHES))
    if not len(text):
        return model
    first = starts[text] + stretch * rng.integers(0, sizes[text])
    of = label[text]
    of_language = [np.flatnonzero(of == j) for j in range(k)]
    present = [j for j in range(k) if len(of_language[j])]
    if not present:
        return model
    squares, pair_squares = np.full(model.weights.shape, 1e-3), np.full((k, k), 1e-3)
    for _ in range(EPOCHS * max(1, len(text) // BATCH)):
        # A sequence stays in a language from one stretch to the next three times of four.
        language = rng.choice(present, (BATCH, 1)).repeat(4, 1)
        for c in range(1, 4):
            moves = rng.random(BATCH) < 0.25
            language[:, c] = np.where(moves, rng.choice(present, BATCH), language[:, c - 1])
        picked = np.empty_like(language)
        for j in present:
            here = language == j
            picked[here] = rng.choice(of_language[j], here.sum())
        places = (first[picked][:, :, None] + np.arange(stretch)).reshape(BATCH, -1).T
        truth = np.repeat(language, stretch, 1).T
        used, inverse = np.unique(codes[places], return_inverse=True)
        inverse = inverse.reshape(places.shape)
        n = bounds[used + 1] - bounds[used]
        ends = np.cumsum(n)
        feats = ids[np.repeat(bounds[used] - (ends - n), n) + np.arange(n.sum())]
        word = np.repeat(np.arange(len(used)), n)
        sums = np.zeros((len(used), k))
        np.add.at(sums, word, model.weights[feats])
        sums[~letters[used]] = 0
        evidence = sums[inverse]
        lengths = np.full(BATCH, SEQUENCE)
        marginals, behind = forward_backward(evidence, lengths, model.transitions)
        error = marginals - np.eye(k)[truth]
        of_word = np.zeros((len(used), k))
        np.add.at(of_word, inverse, error)
        of_word[~letters[used]] = 0
        touched, where = np.unique(feats, return_inverse=True)
        g = np.zeros((len(touched), k))
        np.add.at(g, where, of_word[word] / BATCH)
        g += 1e-4 * model.weights[touched]
        squares[touched] += g**2
        model.weights[touched] -= RATE * 0.2 * g / np.sqrt(squares[touched])
        expected = _pair_sums(marginals, behind, evidence, model.transitions)
        seen = np.zeros((k, k))
        np.add.at(seen, (truth[:-1], truth[1:]), 1)
        g = (expected - seen) / BATCH + 1e-3 * model.transitions
        pair_squares += g**2
        model.transitions -= RATE * 0.2 * g / np.sqrt(pair_squares)
    model.weights[-1] = 0
    return model


def _groups(lengths: np.ndarray, cells: int = 400_000) -> Iterator[np.ndarray]:
    """Texts by descending length, in groups of at most ``cells`` padded places."""
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order) and lengths[order[i]]:
        n = max(1, cells // int(lengths[order[i]]))
        group = order[i : i + n]
        yield group[lengths[group] > 0]
        i += n


def word_languages(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities (word, language) over all words of all texts in a row,
    where each text starts, whether a word has a letter)."""
    codes, starts, dictionary = words(texts)
    evidence, letters = model.evidence(dictionary)
    out = np.zeros((len(codes), len(model.languages)))
    lengths = np.diff(starts)
    for group in _groups(lengths):
        size = lengths[group]
        place = starts[group] + np.minimum(np.arange(size.max())[:, None], size - 1)
        marginals, _ = forward_backward(evidence[codes[place]], size, model.transitions)
        inside = np.arange(size.max())[:, None] < size
        out[place[inside]] = marginals[inside]
    return out, starts, letters[codes] if len(codes) else np.zeros(0, bool)


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and its mean probability over the words with letters."""
    n = len(texts)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    chances, starts, letters = word_languages(model, texts)
    before = np.concatenate([np.zeros((1, chances.shape[1])), np.cumsum(chances * letters[:, None], 0)])
    sums = before[starts[1:]] - before[starts[:-1]]
    counts = np.concatenate([[0], np.cumsum(letters)])
    counts = counts[starts[1:]] - counts[starts[:-1]]
    best = sums.argmax(1)
    any_letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
    known = any_letter.to_numpy(zero_copy_only=False).astype(bool)
    named = [model.languages[b] if x else UNKNOWN for b, x in zip(best, known, strict=True)]
    score = np.clip(sums[np.arange(n), best] / np.maximum(counts, 1), 0, 1)
    return named, np.where(known, score, 0.0)


def learning_rows(docs: DataFrame, folds: int) -> DataFrame:
    """(text, lang) of up to ``LEARN_ROWS`` documents per language outside the
    held-out fold, the same ones wherever the rows lie. Ids are picked first, so
    that no text is moved but theirs."""
    rows = docs.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~shared.held_out("doc_id", folds)
    ).select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    languages = len(rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in lang")
    # The limit by rank is applied in each task before the exchange too.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = (
        rows.select("lang", "h").withColumn("_place", place).where(F.col("_place") <= LEARN_ROWS)
    )
    # At most LEARN_ROWS * MOST_LANGUAGES rows, whatever the table holds.
    picked = picked.select("lang", "h").distinct()
    found = rows.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"])
    return found.orderBy("lang", "h")


def fit(docs: DataFrame, folds: int = 5) -> Model:
    sample = learning_rows(docs, folds).select("text", "lang")
    texts, marks = [], []
    for row in sample.toLocalIterator():
        texts.append(row.text)
        marks.append(row.lang)
    return learn(texts, marks)


def language(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred and
    score (mean probability of that language over the words with letters).

    ``lang`` is only learned from, and only outside the held-out fold. A text
    that is null or has no letter is ``und`` with score 0, as is every text if
    no language is known; more than ``MOST_LANGUAGES`` languages are a ValueError,
    none is left out silently. Rows with the same doc_id are judged apart. Other
    columns are not looked at; an empty table gives an empty result.
    """
    model = fit(docs, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            named, score = predict(model, batch["text"])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(named, pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select(
        "doc_id", shared.held_out("doc_id", folds).alias("held_out"), "lang_pred", "score"
    )
