"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Every word has a character input (statistics of its byte n-grams) and a word
input (its own statistics, if the learning rows know it). A layer turns them
into a vector; a recurrent network with gates reads windows of ``WINDOW`` words
in both directions; attention weighs its states; a document's score is that of
its worst window. Windows start every ``STEP`` words, half a window, so any
passage of that length lies within one.

What documents hold is counted in tasks; the network is trained in one task, on a
sample of bounded size. The driver gets tables of bounded size and weights, no texts.

Labels are known for documents only, so learning alternates: the worst window
of a toxic document under the present weights is taken as toxic, and windows of
clean documents, the worst of them first, as clean. Gates are piecewise linear
and states rational functions of their input, which costs no exponentials.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalktally.llm import shared
from chalktally.llm.words import SMALL_PIECE_BYTES, affixed_ngrams, mixed, pieces, words

WINDOW, STEP = 48, 24
HIDDEN, VECTOR = 8, 8
GRAMS, BUCKETS = (3, 4), 1 << 16
KNOWN_WORDS = 20_000
#: Clean and toxic documents that are learned from, picked by a hash of their id.
LEARN_ROWS = (4800, 1200)
#: Characters of clean and of toxic documents that are learned from. Each kind
#: has its own part, and of a document longer than its share of it come stretches
#: of ``STRETCH`` characters from all over it, picked by a hash.
LEARN_SIZE = (16_000_000, 8_000_000)
STRETCH = 1400
#: The training task looks at words of about so many bytes of text at a time.
PORTION = 2_000_000
#: A round goes over its windows so often that it makes ``STEPS`` steps at least.
ROUNDS, EPOCHS, STEPS, BATCH, RATE = 4, 4, 150, 128, 0.01
#: Weights shrink by this share of a step, so that few labels aren't learned by
#: heart; those of the last round are averaged over its steps.
DECAY = 0.05
_SHRUNK = ("A", "W", "V", "w", "v")
_SIGNS = ".,;:!?*#%&$\"'()[]{}|<>=+-_/\\~^`"


@dataclass
class Model:
    """What scoring needs; all of bounded size."""

    grams: np.ndarray
    known: list[str]
    of_known: np.ndarray
    weights: dict[str, np.ndarray]

    def inputs(self, dictionary: pa.StringArray) -> np.ndarray:
        """The input of every distinct word, a row of zeros at the end."""
        plain = pc.utf8_trim(pc.utf8_lower(dictionary), characters=_SIGNS)
        n = len(plain)
        out = np.zeros((n + 1, 6), np.float32)
        if n:
            hashes, owner = affixed_ngrams(plain, GRAMS)
            odds = self.grams[(hashes % np.uint64(BUCKETS)).astype(np.int64)]
            some = np.unique(owner)
            at = np.searchsorted(owner, some)
            counts = np.diff(np.append(at, len(owner)))
            if len(at):
                out[some, 0] = np.add.reduceat(odds, at) / counts
                out[some, 1] = np.maximum.reduceat(odds, at)
            place = pc.index_in(plain, value_set=pa.array(self.known, pa.string()))
            place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False)
            out[:n, 2] = np.append(self.of_known, np.float32(0))[place]
            out[:n, 3] = place >= 0
            size = pc.binary_length(plain).to_numpy(zero_copy_only=False)
            out[:n, 4] = np.log1p(size)
            out[:n, 5] = 1
        return out


def projected(inputs: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """A word's share of the gates of both directions."""
    out = np.empty((len(inputs), 6 * HIDDEN), np.float32)
    for i in range(0, len(inputs), 16384):
        part = np.tanh(inputs[i : i + 16384] @ w["A"] + w["a"])
        out[i : i + 16384] = part @ w["W"] + w["b"]
    return out


def windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end of the text, text number) of all windows of all texts; a
    text without words has one empty window."""
    sizes = np.diff(starts)
    n = 1 + np.maximum(0, -(-(sizes - WINDOW) // STEP))
    text = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return starts[:-1][text] + STEP * number, starts[1:][text], text


def window_words(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word numbers (window, place), -1 beyond the end of the text."""
    place = first[:, None] + np.arange(WINDOW)
    inside = place < end[:, None]
    if not len(codes):
        return np.full(place.shape, -1)
    return np.where(inside, codes[np.minimum(place, len(codes) - 1)], -1)


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def _states(taken: np.ndarray, table: np.ndarray, w: dict, keep: list | None = None):
    """States (place, window, 2 * HIDDEN) for windows of word numbers; ``table``
    has a word's share of both directions' gates. ``keep`` gets each step."""
    n = len(taken)
    h = np.zeros((2, n, HIDDEN), np.float32)
    out = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
    k = 3 * HIDDEN
    for t in range(WINDOW):
        back = WINDOW - 1 - t
        u = np.stack([table[taken[:, t], :k], table[taken[:, back], k:]])
        v = np.matmul(h, w["V"])
        gates = _gate(u[:, :, : 2 * HIDDEN] + v[:, :, : 2 * HIDDEN])
        z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
        q = v[:, :, 2 * HIDDEN :]
        a = u[:, :, 2 * HIDDEN :] + r * q
        new = a / (1 + np.abs(a))
        if keep is not None:
            keep.append((h, z, r, q, new))
        h = new + z * (h - new)
        out[t, :, :HIDDEN] = h[0]
        out[back, :, HIDDEN:] = h[1]
    return out


def _pooled(states: np.ndarray, taken: np.ndarray, w: dict):
    e = states @ w["v"] + np.where(taken.T < 0, np.float32(-30), np.float32(0))
    e = np.exp(e - e.max(0))
    share = e / e.sum(0)
    pooled = np.einsum("tn,tnh->nh", share, states)
    return share, pooled, pooled @ w["w"] + w["c"][0]


def window_logits(taken: np.ndarray, table: np.ndarray, w: dict, size: int = 2048) -> np.ndarray:
    out = [np.zeros(0, np.float32)]
    for i in range(0, len(taken), size):
        part = taken[i : i + size]
        out.append(_pooled(_states(part, table, w), part, w)[2])
    return np.concatenate(out)


def _gradients(taken: np.ndarray, inputs: np.ndarray, label: np.ndarray, weight, w: dict) -> dict:
    """Of the weighted logistic loss of windows by back-propagation through time."""
    x = inputs[taken]  # (window, place, input)
    vectors = np.tanh(x @ w["A"] + w["a"])
    table = (vectors @ w["W"] + w["b"]).reshape(-1, 6 * HIDDEN).astype(np.float32)
    at = np.arange(taken.size).reshape(taken.shape)
    steps: list = []
    states = _states(at, table, w, steps)
    share, pooled, logit = _pooled(states, taken, w)
    d = weight * (1 / (1 + np.exp(-logit)) - label)
    g = {"w": pooled.T @ d, "c": np.array([d.sum()])}
    d_pooled = d[:, None] * w["w"]
    d_share = np.einsum("nh,tnh->tn", d_pooled, states)
    d_e = share * (d_share - (share * d_share).sum(0))
    g["v"] = np.einsum("tn,tnh->h", d_e, states)
    d_states = share[:, :, None] * d_pooled + d_e[:, :, None] * w["v"]
    n, k = len(taken), 3 * HIDDEN
    d_table = np.zeros((n, WINDOW, 6 * HIDDEN), np.float32)
    g["V"] = np.zeros_like(w["V"])
    dh = np.zeros((2, n, HIDDEN), np.float32)
    turned = w["V"].transpose(0, 2, 1)
    for t in reversed(range(WINDOW)):
        back = WINDOW - 1 - t
        h, z, r, q, new = steps[t]
        dh = dh + np.stack([d_states[t, :, :HIDDEN], d_states[back, :, HIDDEN:]])
        d_a = dh * (1 - z) * (1 - np.abs(new)) ** 2
        d_z = 0.25 * dh * (h - new) * ((z > 0) & (z < 1))
        d_r = 0.25 * d_a * q * ((r > 0) & (r < 1))
        d_v = np.concatenate([d_z, d_r, d_a * r], 2)
        g["V"] += np.matmul(h.transpose(0, 2, 1), d_v)
        d_u = np.concatenate([d_z, d_r, d_a], 2)
        d_table[:, t, :k] += d_u[0]
        d_table[:, back, k:] += d_u[1]
        dh = dh * z + np.matmul(d_v, turned)
    g["W"] = np.einsum("ntv,ntu->vu", vectors, d_table)
    g["b"] = d_table.sum((0, 1))
    d_x = (d_table @ w["W"].T) * (1 - vectors**2)
    g["A"] = np.einsum("nti,ntv->iv", x, d_x)
    g["a"] = d_x.sum((0, 1))
    return g


def _fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def some(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

    return {
        "A": some(6, VECTOR), "a": np.zeros(VECTOR, np.float32),
        "W": some(VECTOR, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, np.float32),
        "V": some(2, HIDDEN, 3 * HIDDEN),
        "v": np.zeros(2 * HIDDEN, np.float32),
        "w": some(2 * HIDDEN, 1)[:, 0], "c": np.zeros(1, np.float32),
    }


def _odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How much likelier toxic documents hold something, as a logarithm, nearer
    to 0 the fewer documents do."""
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return (ratio * (toxic + clean) / (toxic + clean + 4)).astype(np.float32)


def held(parts: list[list[str]], toxic: np.ndarray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """How many toxic and clean documents, each a list of texts, have a bucket of
    n-grams, and have it twice or more in their distinct words: (times, kind,
    bucket). Then their distinct words without signs, and (kind, word)."""
    codes, starts, dictionary = words(pa.array([t for p in parts for t in p], pa.string()))
    plain = pc.utf8_trim(pc.utf8_lower(dictionary), characters=_SIGNS)
    document = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    pairs = np.unique(np.repeat(document, np.diff(starts)) * np.int64(len(plain) + 1) + codes)
    of, word = pairs // (len(plain) + 1), pairs % (len(plain) + 1)
    hashes, owner = affixed_ngrams(plain, GRAMS)
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int32)
    bounds = np.searchsorted(owner, np.arange(len(plain) + 1))
    grams = np.zeros((2, 2, BUCKETS), np.int64)
    # Some documents at a time, as they have many more n-grams than words.
    edges = np.searchsorted(of, np.arange(0, len(parts) + 100, 100))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        sizes = np.diff(bounds)[word[a:b]]
        ends = np.cumsum(sizes)
        at = np.repeat(bounds[word[a:b]] - (ends - sizes), sizes) + np.arange(sizes.sum())
        key = np.repeat(of[a:b], sizes) * np.int64(BUCKETS) + bucket[at]
        seen, times = np.unique(key, return_counts=True)
        is_toxic = toxic[seen // BUCKETS]
        for often in (0, 1):
            for kind in (0, 1):
                these = (times > often) & (is_toxic if kind == 0 else ~is_toxic)
                grams[often, kind] += np.bincount(seen[these] % BUCKETS, minlength=BUCKETS)
    coded = plain.dictionary_encode()
    n = max(len(coded.dictionary), 1)
    same = coded.indices.to_numpy(zero_copy_only=False)
    pairs = np.unique(of * np.int64(n) + (same[word] if len(word) else 0))
    found = np.stack(
        [np.bincount(pairs[toxic[pairs // n] == kind] % n, minlength=n) for kind in (True, False)]
    )
    return grams, coded.dictionary, found


def numbered(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A hash of every word of the texts and where each text starts; the distinct
    hashes and their inputs."""
    codes, starts, dictionary = words(texts)
    key = np.array([xxhash.xxh3_64_intdigest(w) for w in dictionary.to_pylist()], np.uint64)
    return key[codes] if len(key) else np.zeros(0, np.uint64), starts, key, model.inputs(dictionary)[:-1]


def learn(
    codes: np.ndarray,
    starts: np.ndarray,
    of_text: np.ndarray,
    inputs: np.ndarray,
    labels: np.ndarray,
    whole: np.ndarray,
    seed: int = 7,
) -> dict[str, np.ndarray]:
    """Weights fitted to texts of word numbers and the documents they belong to,
    each with its label (1 toxic, 0 clean). ``inputs`` are those of every word, a
    row of zeros at the end. Of a document that isn't ``whole`` the toxic
    passage may be missing: while whole toxic ones are there, its worst window is
    taken as toxic only if the last round's weights say so too."""
    labels = np.asarray(labels, np.float32)
    whole = np.asarray(whole, bool)
    n_toxic = int(labels.sum())
    n_clean = len(labels) - n_toxic
    rng = np.random.default_rng(seed)
    first, end, text = windows(starts)
    text = np.asarray(of_text, np.int64)[text] if len(text) else text
    toxic = labels[text] > 0
    none = np.full((1, WINDOW), -1)
    # To begin with, a window is as bad as its most telling words.
    telling = np.append(inputs[:-1, 1] + inputs[:-1, 2], np.float32(0))
    badness = np.concatenate(
        [np.zeros(0, np.float32)]
        + [
            np.sort(telling[window_words(codes, first[i : i + 4096], end[i : i + 4096])], 1)[:, -3:].sum(1)
            for i in range(0, len(first), 4096)
        ]
    )
    w = _fresh(rng)
    if not n_toxic or not n_clean:
        w["w"][:], w["c"][:] = 0, -10
    memory = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in w.items()}
    step = 0
    # Steps get smaller to the end, so that the last few windows don't decide.
    slower = 1.0
    for round_ in range(ROUNDS if n_toxic and n_clean else 0):
        order = np.lexsort((-badness, text))
        worst = order[np.unique(text[order], return_index=True)[1]]
        bad = worst[toxic[worst]]
        sure = whole[text[bad]]
        if sure.any():
            bad = bad[sure | (badness[bad] > 0)] if round_ else bad[sure]
        hard = worst[~toxic[worst]]
        hard = hard[np.argsort(-badness[hard], kind="stable")][: 2 * len(bad)]
        others = np.flatnonzero(~toxic)
        others = rng.choice(others, min(len(others), 2 * len(bad)), replace=False)
        chosen = np.concatenate([bad, hard, others])
        taken = np.concatenate([window_words(codes, first[chosen], end[chosen]), none])
        label = np.append(toxic[chosen], False).astype(np.float32)
        epochs = max(EPOCHS, -(-STEPS * BATCH // len(taken)))
        less = 0.9 / (ROUNDS * epochs * -(-len(taken) // BATCH))
        total, steps = {k: np.zeros_like(x) for k, x in w.items()}, 0
        for _ in range(epochs):
            shuffled = rng.permutation(len(taken))
            for i in range(0, len(taken), BATCH):
                batch = shuffled[i : i + BATCH]
                step += 1
                slower = max(0.1, slower - less)
                g = _gradients(taken[batch], inputs, label[batch], np.float32(1 / len(batch)), w)
                for name, x in w.items():
                    m, v = memory[name]
                    m += 0.1 * (g[name] - m)
                    v += 0.01 * (g[name] ** 2 - v)
                    scale = RATE * slower * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    move = m / (np.sqrt(v) + 1e-6)
                    if name in _SHRUNK:
                        move = move + DECAY * x
                    x -= (scale * move).astype(np.float32)
                    total[name] += x
                steps += 1
        if round_ == ROUNDS - 1:
            w.update({k: x / np.float32(steps) for k, x in total.items()})
        table = projected(inputs, w)
        badness = np.concatenate(
            [np.zeros(0, np.float32)]
            + [
                window_logits(window_words(codes, first[i : i + 8192], end[i : i + 8192]), table, w)
                for i in range(0, len(first), 8192)
            ]
        )
        # The next round's table is as large; both needn't be there at a time.
        del table
    return w


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """Per text the score of its worst window, from 0 to 1."""
    codes, starts, dictionary = words(texts)
    table = projected(model.inputs(dictionary), model.weights)
    first, end, text = windows(starts)
    worst = np.full(len(texts), -np.inf)
    for i in range(0, len(first), 8192):
        part = slice(i, i + 8192)
        taken = window_words(codes, first[part], end[part])
        np.maximum.at(worst, text[part], window_logits(taken, table, model.weights))
    return 1 / (1 + np.exp(-np.clip(worst, -30, 30)))


def learning_rows(docs: DataFrame, labels: DataFrame, folds: int) -> DataFrame:
    """(doc_id, text, h, toxic) of up to ``LEARN_ROWS`` labelled documents of each
    kind outside the held-out fold, the same ones wherever the rows lie."""
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~shared.held_out("doc_id", folds))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    clean, toxic = (
        marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for kind, n in enumerate(LEARN_ROWS)
    )
    # A bounded number of rows, whatever the tables hold.
    picked = F.broadcast(clean.union(toxic))
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("h")
    ).join(picked, "doc_id")


def share(sizes: np.ndarray, total: int) -> int:
    """The largest size up to which each document may be taken so that all
    together take at most ``total``; short ones leave the others more."""
    sizes = np.sort(sizes).tolist()
    left = total
    for i, size in enumerate(sizes):
        if size * (len(sizes) - i) > left:
            return int(left // (len(sizes) - i))
        left -= size
    return max([total, *sizes[-1:]])


def stretches(text: str, most: int, key: int) -> list[str]:
    """The text, or if it is longer than ``most`` so many characters of it in
    stretches picked by a hash; neighbours are one. A word that is cut by the
    edge of a stretch is left out, unless the stretch is within that word."""
    if len(text) <= most:
        return [text]
    n = -(-len(text) // STRETCH)
    with np.errstate(over="ignore"):
        order = np.argsort(mixed(np.arange(n, dtype=np.uint64) + mixed(np.uint64([key % (1 << 64)]))))
    picked = np.sort(order[: max(1, most // STRETCH)])
    out = []
    for run in np.split(picked, np.flatnonzero(np.diff(picked) > 1) + 1):
        a, b = int(run[0]) * STRETCH, min(len(text), (int(run[-1]) + 1) * STRETCH)
        part = text[a:b]
        inner = part
        if a and not text[a - 1].isspace() and not inner[:1].isspace():
            inner = "".join(inner.split(maxsplit=1)[1:])
        if b < len(text) and not text[b].isspace() and not inner[-1:].isspace():
            inner = "".join(inner.rsplit(maxsplit=1)[:-1])
        out.append(inner if inner.strip() else part)
    return out


def sample(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """What is learned from, written: n, toxic, whole (all of the document is there)
    and its parts, an array of texts. Rows of one doc_id and different text are
    documents of their own, taken when every doc_id has had one before."""
    rows = learning_rows(docs, labels, folds)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))
    sized = (
        rows.groupBy("doc_id", "h", "toxic")
        .agg(F.min(F.length("text")).alias("size"))
        .withColumn("nth", nth)
        .where(F.col("nth") <= max(LEARN_ROWS))
    )
    order = ("nth", F.xxhash64("doc_id"), "doc_id")
    documents = []
    for kind, n in enumerate(LEARN_ROWS):
        found = sized.where(F.col("toxic") == kind).orderBy(*order).limit(n).collect()
        most = share(np.array([r["size"] for r in found], np.int64), LEARN_SIZE[kind])
        documents += [(r.doc_id, r.h, kind, most, r["size"] <= most) for r in found]
    # Kinds mixed, in the same order wherever the rows lie.
    documents.sort(key=lambda d: (zlib.crc32(str(d[:2]).encode()), d))
    chosen = docs.sparkSession.createDataFrame(
        [(i, *d[:2], d[3], d[4]) for i, d in enumerate(documents)],
        "n int, doc_id long, h long, most long, whole boolean",
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [
                stretches(text.as_py(), most.as_py(), h.as_py())
                for text, most, h in zip(batch["text"], batch["most"], batch["h"], strict=True)
            ]
            columns = [batch[c] for c in ("n", "toxic", "whole")]
            columns.append(pa.array(parts, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, ["n", "toxic", "whole", "parts"])

    # Rows that are the same have the same number; one of them is enough.
    rows = rows.dropDuplicates(["doc_id", "h"])
    return shared.written(
        rows.join(F.broadcast(chosen), ["doc_id", "h"])
        .select("n", "toxic", "whole", "text", "most", "h")
        .mapInArrow(cut, "n int, toxic int, whole boolean, parts array<string>"),
        "learning",
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket or word, counts) of the documents of a task."""
    for batch in batches:
        toxic = batch["toxic"].to_numpy(zero_copy_only=False) > 0
        grams, known, found = held(batch["parts"].to_pylist(), toxic)
        some = np.flatnonzero(grams[0].any(0))
        blank = pa.nulls(len(some), pa.string())
        columns = [pa.array(some), blank, *(pa.array(grams[i, k, some]) for i in (0, 1) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, _COUNTED)
        zero = pa.array(np.zeros(len(known), np.int64))
        of = found[:, : len(known)]
        columns = [pa.nulls(len(known), pa.int64()), known, pa.array(of[0]), pa.array(of[1]), zero, zero]
        yield pa.RecordBatch.from_arrays(columns, _COUNTED)


_COUNTED = ["bucket", "word", "toxic", "clean", "twice_toxic", "twice_clean"]


def _statistics(drawn: DataFrame, n_toxic: int, n_clean: int) -> Model:
    """A model without weights yet, from counts over the tasks' documents."""
    shape = "bucket long, word string, toxic long, clean long, twice_toxic long, twice_clean long"
    counts = shared.written(
        drawn.select("toxic", "parts")
        .mapInArrow(_counted, shape)
        .groupBy("bucket", "word")
        .agg(*(F.sum(c).alias(c) for c in _COUNTED[2:])),
        "held",
    )
    found = counts.where("bucket is not null").toArrow()
    table = np.zeros((4, BUCKETS), np.int64)
    at = found["bucket"].to_numpy()
    for i, name in enumerate(_COUNTED[2:]):
        table[i, at] = found[name].to_numpy()
    # What a clean document has once by chance, a toxic one has in several words.
    grams = _odds(*table[:2], n_toxic, n_clean) + _odds(*table[2:], n_toxic, n_clean)
    known = (
        counts.where("bucket is null and toxic + clean >= 3")
        .orderBy(F.desc(F.col("toxic") + F.col("clean")), "word")
        .limit(KNOWN_WORDS)
        .toArrow()
    )
    of_known = _odds(known["toxic"].to_numpy(), known["clean"].to_numpy(), n_toxic, n_clean)
    return Model(grams, known["word"].to_pylist(), of_known, {})


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``PORTION`` bytes of parts, a row at least."""
    for batch in batches:
        parts = batch["parts"]
        sizes = pc.binary_length(parts.flatten()).to_numpy(zero_copy_only=False)
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[offsets[:-1]]
        starts = np.flatnonzero(np.diff(before // PORTION, prepend=-1))
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=bool(len(starts))):
            yield batch.slice(start, end - start)


def _trained(drawn: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Weights, learned in one task from the sample, whose size is bounded, so that
    neither texts nor their words come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, inputs = np.zeros(0, np.uint64), np.zeros((0, 6), np.float32)
        found, starts, document = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], []
        toxic, whole = [], []
        total = 0
        for batch in portions(batches):
            parts = batch["parts"].to_pylist()
            texts = pa.array([t for p in parts for t in p], pa.string())
            hashes, own, more, of_more = numbered(model, texts)
            keys, at = np.unique(np.concatenate([keys, more]), return_index=True)
            inputs = np.concatenate([inputs, of_more])[at]
            found.append(hashes)
            starts.append(own[1:] + total)
            total += len(hashes)
            for p, is_toxic, all_there in zip(parts, batch["toxic"], batch["whole"], strict=True):
                document += [len(toxic)] * len(p)
                toxic.append(is_toxic.as_py())
                whole.append(all_there.as_py())
        codes = np.concatenate([np.searchsorted(keys, f).astype(np.int32) for f in found])
        del found, keys
        inputs = np.concatenate([inputs, np.zeros((1, 6), np.float32)])
        weights = learn(
            codes, np.concatenate(starts), np.array(document, np.int64), inputs, np.array(toxic), np.array(whole, bool)
        )
        data = [w.astype(np.float32).tobytes() for w in weights.values()]
        shapes = [list(w.shape) for w in weights.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(weights)), pa.array(shapes, pa.list_(pa.int32())), pa.array(data, pa.binary())],
            ["name", "shape", "data"],
        )

    rows = drawn.repartition(1).sortWithinPartitions("n").select("toxic", "whole", "parts")
    found = rows.mapInArrow(run, "name string, shape array<int>, data binary").collect()
    return {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in found}


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """A model from labelled rows, as many characters of them as ``LEARN_SIZE``."""
    drawn = sample(docs, labels, folds)
    n_toxic, n = drawn.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    model = _statistics(drawn, n_toxic, n - n_toxic)
    # Without rows a task may see nothing at all.
    model.weights = _trained(drawn, model) or learn(*_NOTHING)
    return model


_NOTHING = (
    np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64),
    np.zeros((1, 6), np.float32), np.zeros(0), np.zeros(0, bool),
)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = pa.array(score_texts(model, batch["text"]))
            columns = [*(batch[c] for c in batch.schema.names if c != "text"), found]
            names = [*(c for c in batch.schema.names if c != "text"), "score"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1) and
    predicted (1 if the score is 0.5 or more).

    Learned from ``labels`` (doc_id, toxic) of documents outside the held-out
    fold; a null label or id isn't learned from, and of several labels of one
    document the largest counts. A null text is empty; an empty text has the
    score of an empty window, which is learned as clean. Rows with the same
    doc_id are scored apart. Without labels of both kinds nothing is toxic.
    Other columns are not looked at; an empty table gives an empty result.
    """
    model = fit(docs, labels, folds)
    return scores(docs, model).select(
        "doc_id",
        shared.held_out("doc_id", folds).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    model = fit(docs, labels, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=SMALL_PIECE_BYTES):
            yield batch.filter(pa.array(score_texts(model, batch["text"]) < 0.5))

    return docs.mapInArrow(run, docs.schema)
