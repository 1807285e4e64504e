"""Language-model scores by a log-bilinear model over word classes.

Word counts come from all learning documents. The ``SHORT`` most frequent words
(the end of a text is one) are classes of their own, all other words share
``BUCKETS`` classes by their first letters. A vector for the coming class is
predicted as a linear map of the vectors of the two classes before it; its
product with each class's own vector, plus a bias, is a score. The parameters
are learned by noise-contrastive estimation: tell the class that came from
classes drawn at random by their frequency. A start is learned from a bounded
pilot; then every partition goes over all of its texts from there, and the
parameters are averaged by words seen.

Scoring is exact: the normalizer of every pair of classes is one entry of a
table of bounded size, made by batched matrix products. A word's probability is
that of its class times its share of the class, the unknown having one in each.
The counts of frequent words are sent to all executors; those of the others, of
which there is no bound, are joined.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalktally.llm import shared
from chalktally.llm.words import mixed, pieces, raw_bytes, words

SHORT, BUCKETS, SIZE = 383, 384, 16
#: Frequent words, at most, whose counts are sent to all executors.
SENT = 100_000
PILOT_DOCS, PILOT_EPOCHS = 1500, 3
BATCH, NOISE, RATE = 2048, 32, 0.1
ADDED = 0.1
CLASSES = SHORT + BUCKETS
START = CLASSES
_SPACE = r"[\x20\x09-\x0D]+"


@dataclass
class Vocabulary:
    """Frequent words and their counts, the mass (counts plus 0.1 each) of each
    class, and the totals over all words. The empty word is a text's end."""

    words: pa.StringArray
    counts: np.ndarray
    masses: np.ndarray
    tokens: int
    kinds: int

    def look_up(self, dictionary: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of words; count -1 if it isn't among the frequent."""
        place = pc.fill_null(pc.index_in(dictionary, value_set=self.words), -1)
        place = place.to_numpy(zero_copy_only=False)
        found = np.where(place >= 0, self.counts[place] if len(self.counts) else 0, -1)
        return np.where((place >= 0) & (place < SHORT), place, SHORT + bucket(dictionary)), found


def bucket(dictionary: pa.StringArray) -> np.ndarray:
    """A number from the first two bytes of each word."""
    data, starts = raw_bytes(dictionary)
    data = np.append(data, np.zeros(2, np.uint8)).astype(np.uint64)
    first, size = starts[:-1], np.diff(starts)
    one = np.where(size > 0, data[first], 0).astype(np.uint64)
    two = np.where(size > 1, data[first + 1], 0).astype(np.uint64)
    return (mixed(one * np.uint64(256) + two + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts, ""))


def vocabulary(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """((word, c) of all words of (text), what is sent to the executors)."""
    text = shared.lower_ascii(F.coalesce("text", F.lit("")))
    # The outer form: the other one splits every text again to see if it has words.
    each = docs.select(F.explode_outer(F.split(text, _SPACE)).alias("word")).where("word <> ''")
    ends = docs.agg(F.count("*").alias("c")).where("c > 0").select(F.lit("").alias("word"), "c")
    counted = each.groupBy("word").agg(F.count("*").alias("c")).union(ends)
    counts = shared.written(counted, "counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # Counts in steps of about a hundredth, of which there are a few thousand at
    # most: the lowest step from which on the words are few enough.
    steps = counts.groupBy(F.floor(F.log("c") * 64).alias("step")).count().collect()
    least, above = np.inf, 0
    for step, n in sorted(steps, reverse=True):
        above += n
        if above > SENT:
            break
        least = step
    often = counts.where((F.floor(F.log("c") * 64) >= float(least)) | (F.col("word") == "")).toPandas()
    # The end first, so that it always is a class of its own.
    often["inner"] = often["word"] != ""
    often = often.sort_values(["inner", "c", "word"], ascending=[True, False, True])
    listed = often["word"].tolist() or [""]
    numbers = often["c"].to_numpy(np.int64) if len(often) else np.zeros(1, np.int64)
    if listed[0] != "":
        listed, numbers = ["", *listed], np.concatenate([[0], numbers])
    found = Vocabulary(pa.array(listed, pa.string()), numbers, np.zeros(CLASSES), tokens, kinds)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, _ = found.look_up(batch["word"])
            mass = np.bincount(classes, batch["c"].to_numpy() + ADDED, CLASSES)
            some = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(mass[some])], ["class", "mass"]
            )

    total = counts.mapInArrow(masses, "class long, mass double").groupBy("class")
    for row in total.agg(F.sum("mass").alias("mass")).collect():  # a row per class
        found.masses[row["class"]] = row["mass"]
    found.masses[SHORT:] += ADDED
    found.masses[:SHORT] = np.maximum(found.masses[:SHORT], ADDED)
    return counts, found


def _classes(texts: pa.Array, vocabulary: Vocabulary):
    """(class of each token of all texts in a row, the end included, the word
    numbers with -1 for the end, where texts start, dictionary, its counts)."""
    codes, starts, dictionary = words(_lowered(texts))
    of_word, counts = vocabulary.look_up(dictionary)
    starts = starts + np.arange(len(starts))
    numbers = np.full(starts[-1], -1)
    inner = np.ones(starts[-1], bool)
    inner[starts[1:] - 1] = False
    numbers[inner] = codes
    classes = np.zeros(len(numbers), np.int64)
    classes[inner] = of_word[codes] if len(codes) else 0
    return classes, numbers, starts, dictionary, counts


def _before(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class one and two places before, the start sign at a text's start."""
    one, two = np.roll(classes, 1), np.roll(classes, 2)
    one[starts[:-1]] = START
    two[starts[:-1]] = START
    second = starts[:-1] + 1
    two[second[second < starts[1:]]] = START
    return one, two


class Parameters(dict):
    """R: vectors of classes before, L1 and L2: maps by place, Q and b: vectors
    and biases of the coming class."""

    @staticmethod
    def fresh(masses: np.ndarray, seed: int = 3) -> Parameters:
        rng = np.random.default_rng(seed)
        return Parameters(
            R=0.3 * rng.standard_normal((CLASSES + 1, SIZE)),
            L1=np.eye(SIZE), L2=0.5 * np.eye(SIZE),
            Q=0.1 * rng.standard_normal((CLASSES, SIZE)), b=np.log(masses / masses.sum()),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([self[k].reshape(-1) for k in ("R", "L1", "L2", "Q", "b")])

    @staticmethod
    def of(flat: np.ndarray) -> Parameters:
        shapes = {
            "R": (CLASSES + 1, SIZE), "L1": (SIZE, SIZE), "L2": (SIZE, SIZE),
            "Q": (CLASSES, SIZE), "b": (CLASSES,),
        }
        out, at = Parameters(), 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape).copy()
            at += n
        return out


class Learner:
    """Steps of noise-contrastive estimation, shrinking per parameter."""

    def __init__(self, parameters: Parameters, masses: np.ndarray, seed: int):
        self.p = Parameters.of(parameters.flat())
        self.squares = {k: np.full(v.shape, 1e-2) for k, v in self.p.items()}
        chance = masses / masses.sum()
        self.log_noise = np.log(NOISE * chance)
        self.cumulated = np.cumsum(chance)
        self.rng = np.random.default_rng(seed)

    @staticmethod
    def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        at = (rows[:, None] * SIZE + np.arange(SIZE)).reshape(-1)
        return np.bincount(at, values.reshape(-1), n * SIZE).reshape(n, SIZE)

    def batch(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p = self.p
        noise = np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1])
        noise = np.minimum(noise, CLASSES - 1)
        r1, r2, q, qn = p["R"][one], p["R"][two], p["Q"][target], p["Q"][noise]
        h = r1 @ p["L1"] + r2 @ p["L2"]
        real = np.einsum("bs,bs->b", h, q) + p["b"][target] - self.log_noise[target]
        drawn = h @ qn.T + p["b"][noise] - self.log_noise[noise]
        d_real = -1 / (1 + np.exp(np.clip(real, -30, 30)))
        d_drawn = 1 / (1 + np.exp(-np.clip(drawn, -30, 30)))
        dh = d_real[:, None] * q + d_drawn @ qn
        dq = self._scatter(target, d_real[:, None] * h, CLASSES)
        np.add.at(dq, noise, d_drawn.T @ h)
        db = np.bincount(target, d_real, CLASSES) + np.bincount(noise, d_drawn.sum(0), CLASSES)
        n = CLASSES + 1
        dr = self._scatter(one, dh @ p["L1"].T, n) + self._scatter(two, dh @ p["L2"].T, n)
        for name, g in (("R", dr), ("L1", r1.T @ dh), ("L2", r2.T @ dh), ("Q", dq), ("b", db)):
            g = g / len(target)
            self.squares[name] += g * g
            p[name] -= RATE * g / np.sqrt(self.squares[name])

    def texts(self, texts: pa.Array, known: Vocabulary) -> int:
        classes, _, starts, *_ = _classes(texts, known)
        one, two = _before(classes, starts)
        order = self.rng.permutation(-(-len(classes) // BATCH))
        for i in order * BATCH:
            part = slice(i, i + BATCH)
            self.batch(classes[part], one[part], two[part])
        return len(classes)


def _averaged(docs: DataFrame, start: Parameters, known: Vocabulary) -> Parameters:
    """Every partition learns from all of its texts; the mean by words seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen = Learner(start, known.masses, 5), 0
        for batch in pieces(batches):
            seen += learner.texts(batch["text"], known)
        if seen:
            flat = learner.p.flat()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen),
                 pa.array(np.full(len(flat), seen))],
                ["i", "v", "n"],
            )

    found = (
        docs.select(F.col("text").cast("string"))
        .mapInArrow(run, "i int, v double, n long")
        .groupBy("i")
        .agg((F.sum("v") / F.sum("n")).alias("v"))
        .toPandas()  # a row per parameter
    )
    if found.empty:
        return start
    return Parameters.of(found.sort_values("i")["v"].to_numpy())


@dataclass
class Model:
    known: Vocabulary
    first: np.ndarray  # (class, SIZE) share of the class one place before
    second: np.ndarray
    own: np.ndarray
    bias: np.ndarray
    normalizers: np.ndarray  # (one before, two before) log of the sum of exponentials

    @staticmethod
    def of(p: Parameters, known: Vocabulary) -> Model:
        first, second = p["R"] @ p["L1"], p["R"] @ p["L2"]
        own, bias = p["Q"].astype(np.float32), p["b"].astype(np.float32)
        table = np.empty((CLASSES + 1, CLASSES + 1), np.float32)
        for i in range(CLASSES + 1):
            s = (first[i] + second).astype(np.float32) @ own.T + bias
            top = s.max(1)
            table[i] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return Model(known, first, second, p["Q"], p["b"], table)

    def log10_classes(self, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Normalized log10 probability of each token's class after those before."""
        one, two = _before(classes, starts)
        out = np.empty(len(classes))
        for i in range(0, len(classes), 1 << 17):
            c, a, b = (x[i : i + (1 << 17)] for x in (classes, one, two))
            h = self.first[a] + self.second[b]
            s = np.einsum("bs,bs->b", h, self.own[c]) + self.bias[c]
            out[i : i + (1 << 17)] = s - self.normalizers[a, b]
        return out / np.log(10)


def fit(docs: DataFrame) -> tuple[DataFrame, Model]:
    """(counts of all words, model) from all texts of ``docs`` (doc_id, text)."""
    counts, known = vocabulary(docs)
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("h"))
    # A bounded number of rows; hashes are picked first, so that only their texts move.
    picked = hashed.select("h").orderBy("h").limit(PILOT_DOCS).distinct()
    pilot = hashed.join(F.broadcast(picked), "h").orderBy("h")
    learner = Learner(Parameters.fresh(known.masses), known.masses, 1)
    texts = pa.array([r.text for r in pilot.toLocalIterator()], pa.string())
    for _ in range(PILOT_EPOCHS if len(texts) else 0):
        learner.texts(texts, known)
    return counts, Model.of(_averaged(docs, learner.p, known), known)


def scores(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of ``docs``."""
    known = model.known
    whole = np.log10(known.tokens + ADDED * (known.kinds + 1))
    log_mass = np.log10(known.masses)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            classes, numbers, starts, dictionary, counted = _classes(batch["text"], known)
            text = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            end = numbers < 0
            c = np.where(end, known.counts[0], counted[numbers] if len(counted) else 0)
            rare = c < 0
            log_count = np.where(rare, 0.0, np.log10(np.where(rare, 1, c) + ADDED))
            # What is missing for a rare word is the logarithm of its count alone.
            inside = np.where(classes < SHORT, 0.0, log_count - log_mass[classes])
            n = batch.num_rows
            score = np.bincount(text, model.log10_classes(classes, starts) + inside, n)
            offsets = np.concatenate([[0], np.cumsum(rare)])[starts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(np.frombuffer(os.urandom(8 * n), np.int64)),
                    pa.array(np.diff(starts)),
                    pa.array(np.bincount(text, c > 0, n).astype(np.int64)),
                    pa.array(np.bincount(text, log_count - whole, n)),
                    pa.array(score),
                    pa.ListArray.from_arrays(
                        pa.array(offsets.astype(np.int32)),
                        dictionary.take(pa.array(numbers[rare])).cast(pa.string()),
                    ),
                ],
                ["doc_id", "row", "n_tokens", "n_known", "base_score", "score", "rare"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = shared.written(
        rows.mapInArrow(
            run,
            "doc_id long, row long, n_tokens long, n_known long, base_score double, "
            "score double, rare array<string>",
        ),
        "scored",
    )
    more = F.log10(F.coalesce("c", F.lit(0)) + ADDED)
    missing = (
        parts.select("doc_id", "row", F.explode("rare").alias("word"))
        .join(counts, "word", "left")
        .select(
            "doc_id", "row", F.lit(0).cast("long").alias("n_tokens"),
            F.col("c").isNotNull().cast("long").alias("n_known"),
            more.alias("base_score"), more.alias("score"),
        )
    )
    names = ["n_tokens", "n_known", "base_score", "score"]
    return (
        parts.drop("rare")
        .unionByName(missing)
        .groupBy("doc_id", "row")
        .agg(*(F.sum(c).alias(c) for c in names))
        .drop("row")
    )


def language_model(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known
    (tokens that occur in learning documents), train_tokens, base_score (log10
    probability by counts alone) and score (the model's log10 probability).

    Learned from all rows outside the held-out fold. Tokens are words in lower
    case (A-Z) and then the end of the text; a null text is empty and has the end
    alone. A row without doc_id isn't held out. Rows with the same doc_id are
    scored apart. Without any learning row every word is unknown. Other columns
    are not looked at; an empty table gives an empty result.
    """
    learning = docs.where(~shared.held_out("doc_id", folds)).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    counts, model = fit(learning)
    return scores(docs, counts, model).select(
        "doc_id",
        shared.held_out("doc_id", folds).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.known.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
