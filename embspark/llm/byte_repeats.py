"""Removal of repeated byte strings by suffix arrays built by linear grouping."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from embspark.llm.common import documents, encoded, slices, to_batch
from embspark.llm.grouping import common_prefixes, suffix_array
from embspark.llm.repeats import SPANS, Stretches, Unit, merged, with_spans

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
#: Bytes of the shorter passages that op6 reports beside what it removes: below the length of 51 words in any of the languages.
PASSAGE = 200
LETTERS = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class ByteWindows(Unit):
    """Windows of ``length`` bytes around anchors of k bytes.

    Stretches are cut into blocks counted from their anchor and written as one text of
    block names, in the order of their bytes. Its suffix array is then also the order of
    the bytes that follow each block's start, and the letters that neighbours share, with
    the bytes they share beyond, give the classes of equal windows.
    """

    def __init__(self, length: int = 400, keep_first: bool = False, passage: int | None = None):
        self.levels = [(length, keep_first)] + ([] if passage is None else [(passage, True)])
        least = min(x for x, _ in self.levels)
        self.k, self.block = max(2, min(32, least // 4)), max(1, min(32, least // 6))

    def tokens(self, text: bytes) -> np.ndarray:
        return LETTERS[np.frombuffer(text, np.uint8)]

    def packed(self, text: bytes, tokens: np.ndarray) -> bytes:
        return text

    def classes(self, rows: Stretches) -> list[np.ndarray]:
        index: dict[tuple, int] = {}
        ranges = zip(*(x.tolist() for pair in zip(rows.lo, rows.n, strict=True) for x in pair), strict=True)
        own = np.array([index.setdefault(key, len(index)) for key in zip(rows.group.tolist(), rows.at.tolist(), ranges, rows.tokens, strict=True)])
        contexts = list(index)
        groups = np.array([c[0] for c in contexts])
        mixed = np.flatnonzero(np.bincount(groups)[groups] > 1)
        found = self.equal_windows([contexts[c][1:] for c in mixed]) if len(mixed) else [np.zeros(0, np.int64)] * len(self.levels)
        out = []
        for level, classes in enumerate(found):
            sizes = np.array([c[2][2 * level + 1] for c in contexts])
            base = np.cumsum(sizes) - sizes
            ids = np.arange(int(sizes.sum()))
            few = sizes[mixed]
            where = np.repeat(base[mixed] - np.cumsum(few) + few, few) + np.arange(int(few.sum()))
            ids[where] = np.where(classes >= 0, classes + len(ids), ids[where])
            n = rows.n[level]
            window = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append(ids[np.repeat(base[own], n) + window])
        return out

    def equal_windows(self, contexts: list[tuple[int, tuple[int, ...], bytes]]) -> list[np.ndarray]:
        """For each level, for the windows of all contexts (at, ranges, text) in turn: a number, equal for equal windows; -1 for some that have no equal."""
        step = self.block
        blocks: list[bytes | None] = []
        context, byte = [], []
        for c, (at, _, text) in enumerate(contexts):
            cuts = range(at % step, len(text), step)
            blocks += [text[b : b + step] for b in cuts]
            blocks.append(None)
            byte += [*cuts, len(text)]
            context += [c] * (len(cuts) + 1)
        named = sorted({b for b in blocks if b is not None})
        name = {b: i for i, b in enumerate(named)}
        context, byte = np.array(context), np.array(byte)
        text = np.array([-1 - c if b is None else name[b] for b, c in zip(blocks, context.tolist(), strict=True)], np.int64)
        order = suffix_array(text)
        letters = common_prefixes(text, order)
        # bytes shared with the suffix before: whole blocks, and what the next two blocks have in common
        spelt = np.frombuffer(b"".join(b.ljust(step, b"\0") for b in named) + bytes(step), np.uint8).reshape(-1, step)
        filled = np.array([*map(len, named), 0])
        ends = np.cumsum([len(c[2]) for c in contexts])
        left = np.array([len(c[2]) for c in contexts])[context] - byte
        p, q = np.r_[order[:1], order[:-1]], order
        last = len(text) - 1
        a, b = (np.maximum(text[np.minimum(x + letters, last)], -1) for x in (p, q))
        other = spelt[a] != spelt[b]
        alike = np.minimum(np.where(other.any(axis=1), other.argmax(axis=1), step), np.minimum(filled[a], filled[b]))
        shared = np.minimum(letters * step + alike, np.minimum(left[p], left[q]))
        shared[:1] = 0

        most = np.maximum(shared, np.r_[shared[1:], 0])
        whole = np.frombuffer(b"".join(x[2] for x in contexts), np.uint8)
        begin = ends - np.array([len(x[2]) for x in contexts])
        back, found = np.arange(1, step), []
        for level, (length, _) in enumerate(self.levels):
            low, sizes = (np.array([x[1][2 * level + j] for x in contexts]) for j in (0, 1))
            base = np.cumsum(sizes) - sizes
            out = np.full(int(sizes.sum()), -1, np.int64)
            found.append(out)
            sure = np.flatnonzero((most > length - step) & (text[order] >= 0) & (sizes[context[order]] > 0))
            if not len(sure):
                continue
            # what a suffix shares with the one chosen before it: the least of all in between
            apart = np.r_[0, range_minima(shared, sure)]
            c, b = context[order[sure]], byte[order[sure]]
            # the bytes before each block, read backwards
            heads = np.where(back <= b[:, None], whole[np.maximum(begin[c][:, None] + b[:, None] - back, 0)], 0).astype(np.uint8)
            before, used = Heads(heads), 0
            for head in range(step):  # bytes of the window before its first block
                window = b - head - low[c]
                own = np.flatnonzero((window >= 0) & (window < sizes[c]))
                if len(own):
                    pair = np.cumsum(apart < length - head)[own] * (len(sure) + 1) + before.at_depth(head)[own]
                    nodes, number = np.unique(pair, return_inverse=True)
                    out[base[c[own]] + window[own]] = used + number
                    used += len(nodes)
        return found


def range_minima(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The least of ``values`` beyond each of ``places`` (ascending), up to and with the next."""
    if len(places) < 2:
        return np.zeros(0, values.dtype)
    return np.minimum.reduceat(values[: places[-1] + 1], places[:-1] + 1)


class Heads:
    """Short byte strings (rows) in order, and how much neighbours share."""

    def __init__(self, rows: np.ndarray):
        n, size = rows.shape
        room = np.zeros((n, size + -size % 8), np.uint8)
        room[:, :size] = rows
        keys = np.ascontiguousarray(room).view(">u8")
        self.order = np.lexsort(keys.T[::-1]) if keys.shape[1] else np.arange(n)
        ranked = rows[self.order]
        other = ranked[1:] != ranked[:-1]
        self.shared = np.where(other.any(axis=1), other.argmax(axis=1), size) if size else np.zeros(max(0, n - 1), np.int64)

    def at_depth(self, depth: int) -> np.ndarray:
        """For each row a number, equal for those that agree in ``depth`` bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(np.r_[True, self.shared < depth])[: len(out)]
        return out


def remove_repeats(docs: DataFrame, length: int = 400, keep_first: bool = False, passage: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs(doc_id, text, ...)``.

    A byte goes if a string of ``length`` bytes over it also starts elsewhere, in another
    document or the same one (``keep_first``: earlier, by doc_id and place). Null or
    empty text: no bytes. Rows that repeat an id with the same text are one document, not
    copies of each other; null ids take no part.

    With ``passage`` there is also ``n_repeated``: bytes, none of which go, that lie in a
    string of ``passage`` bytes that starts earlier too. Both lengths are settled together.
    """
    schema = OUT if passage is None else pa.schema([*OUT, ("n_repeated", pa.int64())])

    def run(batches):
        for part in slices(batches):
            rows = []
            for doc, text, found in zip(part.column("doc_id").to_pylist(), encoded(part.column("text")), part.column(SPANS).to_pylist(), strict=True):
                cuts = merged(found, len(text))
                left = hashlib.sha256()
                at = 0
                for lo, hi in cuts:
                    left.update(text[at:lo])
                    at = hi
                left.update(text[at:])
                row = (doc, len(text), sum(hi - lo for lo, hi in cuts), len(cuts), left.hexdigest())
                rows.append(row if passage is None else (*row, sum(hi - lo for lo, hi in merged(found, len(text), 1))))
            yield to_batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    table = with_spans(docs.select("doc_id", "text"), ByteWindows(length, keep_first, passage))
    return table.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * (passage is not None))


def cut_text(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """The text without these ranges; a range gives up bytes of characters that it holds in part."""
    out, at = [], 0
    for lo, hi in cuts:
        while lo < hi and text[lo] & 0xC0 == 0x80:
            lo += 1
        while lo < hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi -= 1
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])


def deduplicated_texts(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with all columns; of strings of ``length`` bytes that repeat, the first is left.

    A text that loses bytes and has no word left goes; texts that had none before stay, null ones too.
    """
    names = docs.columns

    def run(batches):
        for part in slices(batches):
            texts, sizes, stay = [], [], []
            for text, found in zip(part.column("text").to_pylist(), part.column(SPANS).to_pylist(), strict=True):
                stay.append(True)
                if text and found:
                    raw = text.encode()
                    left = cut_text(raw, merged(found, len(raw)))
                    text, stay[-1] = left.decode(), bool(left.split())
                texts.append(text)
                sizes.append(len(text or ""))
            part = part.filter(pa.array(stay))
            texts, sizes = ([x for x, s in zip(xs, stay, strict=True) if s] for xs in (texts, sizes))
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in names if n in part.schema.names], names=[n for n in names if n in part.schema.names])

    found = with_spans(docs, ByteWindows(length, keep_first=True))
    return found.mapInArrow(run, docs.schema)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), 400, passage=PASSAGE)
