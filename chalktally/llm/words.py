"""Words of a batch of texts as arrays, for functions that get Arrow batches.

A word of a text is a run without ASCII white space. Every distinct word of a
piece of a batch is looked at once; texts are then arrays of word numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 8_000_000
#: For the pipeline's steps: what is made of a piece's words is many times its
#: size, and a worker keeps part of it for the stages that follow.
SMALL_PIECE_BYTES = 2_000_000
NGRAM_VALUES = 20_000


def pieces(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``size`` bytes of text, a row at least, so
    that memory doesn't depend on how many rows come at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // size
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(start, end - start)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(word numbers of all texts in a row, where each text starts with the end
    as last entry, the distinct words). A null text has no words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy(zero_copy_only=False) - lists.offsets[0].as_py()
    filled = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    keep = filled[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], before[offsets], coded.dictionary


def raw_bytes(values: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes in a row, where each value starts with the end as last entry)."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)
    offsets = offsets[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every bit of the input moves every bit out."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def affixed_ngrams(
    values: pa.StringArray, sizes: tuple[int, ...], seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all byte n-grams of each value with a mark before its first and
    after its last byte, so that those at the ends are its affixes, and the
    number of the value each belongs to, ascending. Some values at a time, as
    what is needed in between is many times their size."""
    found = [
        _affixed_ngrams(values.slice(i, NGRAM_VALUES), sizes, seed, i)
        for i in range(0, max(len(values), 1), NGRAM_VALUES)
    ]
    return np.concatenate([h for h, _ in found]), np.concatenate([o for _, o in found])


def _affixed_ngrams(values, sizes, seed, number) -> tuple[np.ndarray, np.ndarray]:
    data, starts = raw_bytes(values)
    n = len(values)
    lengths = np.diff(starts)
    marked = np.ones(len(data) + 2 * n, np.uint64)
    begin = starts[:-1] + 2 * np.arange(n)
    inside = np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(n), lengths)
    marked[inside] = data.astype(np.uint64) + np.uint64(2)
    of = np.repeat(np.arange(n, dtype=np.int32), lengths + 2)
    end = np.repeat(begin + lengths + 2, lengths + 2)
    place = np.arange(len(marked))
    hashes, owners = [], []
    for size in sizes:
        fits = place + size <= end
        at = place[fits]
        h = np.full(len(at), np.uint64(size + 16 * seed))
        for k in range(size):
            h = h * np.uint64(1000003) + marked[at + k]
        hashes.append(mixed(h))
        owners.append(of[fits])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], owner[order] + np.int32(number)
