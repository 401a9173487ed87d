"""Removal of repeated word windows by suffix trees over groups of suffixes with one prefix.

The suffixes are those that begin at anchors: every window of ``length`` words holds one
(a sparse suffix tree). The anchor's words are the prefix by which suffixes are dealt
into groups; the prefix of a common anchor is lengthened to the whole window, so that
every group fits into memory. A group has two trees, of what follows the anchors and of
what stands before them, read backwards; two windows are equal if both of their parts
lie below the same nodes, as deep as the parts are long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from embspark.llm.common import documents, encoded, slices, to_batch
from embspark.llm.repeats import SPANS, Stretches, Unit, merged, with_spans
from embspark.llm.suffix_trees import Tree

OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def word_tokens(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class _Words:
    """Slices give 32 bits of each word's hash."""

    def __init__(self, tokens: np.ndarray):
        self.ids = tokens.astype(np.uint32)

    def __getitem__(self, cut: slice) -> bytes:
        return self.ids[cut].tobytes()


class WordWindows(Unit):
    """Windows of ``length`` words around anchors of k words."""

    def __init__(self, length: int = 20, k: int = 6):
        self.length, self.k, self.levels = length, min(k, length), [(length, True)]

    def tokens(self, text: bytes) -> np.ndarray:
        return word_tokens(text)

    def packed(self, text: bytes, tokens: np.ndarray) -> _Words:
        return _Words(tokens)

    def classes(self, rows: Stretches) -> list[np.ndarray]:
        words = np.frombuffer(b"".join(rows.tokens), np.uint32)
        (n,) = rows.n
        size = n + self.length - 1
        anchor = np.cumsum(size) - size + rows.at
        most = self.length - self.k

        def letters(step: int, count: int, known: np.ndarray) -> np.ndarray:
            """``count`` words from the anchors on (or before them), zero beyond the ``known`` ones."""
            far = np.arange(count)
            cells = anchor[:, None] + (far if step > 0 else -1 - far)
            return np.where(far < known[:, None], words[np.clip(cells, 0, len(words) - 1)], 0).astype(np.uint32)

        after = Tree(letters(1, self.length, size - rows.at), rows.group)
        before = Tree(letters(-1, most, rows.at))
        base = np.cumsum(n) - n
        out, used = np.empty(int(n.sum()), np.int64), 0
        for left in range(most + 1):  # words of the window before its anchor
            window = rows.at - left
            own = np.flatnonzero((window >= 0) & (window < n))
            if len(own):
                pair = after.at_depth(self.length - left)[own] * (len(n) + 1) + before.at_depth(left)[own]
                nodes, number = np.unique(pair, return_inverse=True)
                out[base[own] + window[own]] = used + number
                used += len(nodes)
        return [out]


def remove_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs(doc_id, text, ...)``.

    A word goes if a window of ``length`` words over it also starts earlier: in a smaller
    doc_id, or before in the same document. Null or empty text: no words. Rows that
    repeat an id with the same text are one document, not copies of each other; null ids
    take no part. Words are compared by 32 bits of a hash each, ``length`` of them in a
    row, within groups that share a 64-bit hash; windows of common anchors by 128 bits.
    """

    def run(batches):
        for part in slices(batches):
            rows = []
            for doc, text, found in zip(part.column("doc_id").to_pylist(), encoded(part.column("text")), part.column(SPANS).to_pylist(), strict=True):
                words = text.split()
                gone, left, at = 0, [], 0
                for lo, hi in merged(found, len(words)):
                    left += words[at:lo]
                    gone, at = gone + hi - lo, hi
                left += words[at:]
                rows.append((doc, len(words), gone, hashlib.sha256(b" ".join(left)).hexdigest()))
            yield to_batch(OUT, **dict(zip(OUT.names, zip(*rows, strict=True), strict=True)))

    table = with_spans(docs.select("doc_id", "text"), WordWindows(length))
    return table.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), 20)
