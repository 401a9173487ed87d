"""Packing token sequences: pattern counts by non-negative least squares, then best fit.

The driver only sees the histogram of piece lengths (``capacity`` numbers). Patterns
of two and three pieces that fill a sequence exactly are fitted to it, their counts
rounded within what the histogram holds, and what is left is packed best fit first.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embspark.llm.common import checkpoint, documents, encoded, slices, to_batch

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Patterns of three lengths tried for each longest length.
TRIPLES = 3
#: About so many pieces of one length are ranked in one group.
GROUP_ROWS = 50_000

Pattern = tuple[tuple[int, int], ...]  # (length, repeats) runs


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    def run(batches):
        from embspark.llm.subwords import WordEncoder

        coder, end = WordEncoder(path), np.array([end_id], "<u4").tobytes()
        for part in slices(batches):
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode(encoded(part.column("text"))), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at >> 2, len(cut) >> 2, zlib.crc32(cut)))
            yield to_batch(PIECES, **dict(zip(PIECES.names, zip(*rows, strict=True), strict=True)))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def exact_patterns(held: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the capacity, of lengths that occur."""
    capacity = len(held) - 1
    present = np.flatnonzero(held)
    rows = [(int(a), int(capacity - a), 0) for a in present if 2 * a >= capacity and a < capacity and held[capacity - a]]
    for a in present:
        rest = capacity - a
        b = present[(present <= a) & (present < rest) & (2 * present >= rest)]
        b = b[held[rest - b] > 0]
        if len(b):
            best = b[np.argsort(-np.minimum(held[b], held[rest - b]), kind="stable")[:TRIPLES]]
            rows += [(int(a), int(x), int(rest - x)) for x in best]
    return np.array(rows, np.int64).reshape(-1, 3)


def fit_counts(patterns: np.ndarray, held: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 with least squared distance between the patterns' lengths and the histogram (accelerated projected gradient)."""
    target = held.astype(float)
    target[0] = 0
    used = np.bincount(patterns.ravel(), minlength=len(held)).astype(float)
    rate = 1 / max(1.0, 3 * used[1:].max())
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        short = np.bincount(patterns.ravel(), np.repeat(y, 3), minlength=len(held)) - target
        short[0] = 0
        new = np.maximum(0, y - rate * short[patterns].sum(axis=1))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / s * (new - x), s
    return x


def best_fit(held: np.ndarray) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, over the histogram: sequences with equal contents are handled together."""
    capacity = len(held) - 1
    free: list[dict[Pattern, int]] = [{} for _ in range(capacity + 1)]
    open_at = np.zeros(capacity + 1, bool)

    def put(room: int, pattern: Pattern, n: int) -> None:
        free[room][pattern] = free[room].get(pattern, 0) + n
        open_at[room] = True

    for length in range(capacity, 0, -1):
        n = int(held[length])
        while n:
            room = length + int(np.argmax(open_at[length:]))
            if open_at[room]:
                pattern, bins = free[room].popitem()
            else:
                room, pattern, bins = capacity, (), n
            fits = room // length
            full = min(bins, n // fits)
            if full:
                put(room - fits * length, (*pattern, (length, fits)), full)
                n, bins = n - full * fits, bins - full
            if n and n < fits and bins:
                put(room - n * length, (*pattern, (length, n)), 1)
                n, bins = 0, bins - 1
            if pattern and bins:
                put(room, pattern, bins)
            open_at[room] = bool(free[room])
    return [(p, n) for at in free for p, n in at.items()]


def pack_histogram(held: np.ndarray) -> list[tuple[Pattern, int]]:
    """Patterns with their counts; together they use up ``held`` (pieces by length) exactly."""
    left, out = held.astype(np.int64).copy(), []
    patterns = exact_patterns(left)
    if len(patterns):
        want = fit_counts(patterns, left)
        for k in np.argsort(-want, kind="stable"):
            runs = Counter(x for x in patterns[k].tolist() if x)
            n = min(int(want[k] + 0.5), *(int(left[x]) // m for x, m in runs.items()))
            if n > 0:
                out.append((tuple(sorted(runs.items(), reverse=True)), n))
                for x, m in runs.items():
                    left[x] -= n * m
    return out + best_fit(left)


def plan_table(patterns: list[tuple[Pattern, int]], capacity: int) -> np.ndarray:
    """Rows length, lo, repeats, first sequence, offset: where the pieces of a length with rank lo and on go; sorted."""
    used, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for pattern, n in patterns:
        offset = 0
        for length, m in pattern:
            rows.append((length, int(used[length]), m, sequence, offset))
            used[length] += n * m
            offset += length * m
        sequence += n
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece of each row of ``docs(doc_id, text, ...)``: where its tokens go.

    A document is its text's ids and then ``end_id``; only longer ones than
    ``capacity`` are cut. Null or empty text: the one token ``end_id``. Null ids and
    repeated rows are packed like any other; an empty table gives no rows. Pieces of one
    length are ranked in salted groups, so that a common length is not one task's.
    """
    pieces = checkpoint(token_pieces(docs, path, capacity, end_id))
    held = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        held[r["length"]] = r["count"]
    plan = plan_table(pack_histogram(held), capacity)
    salts = max(1, int(held.max()) // GROUP_ROWS)

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").count()
    starts = starts.select("length", "salt", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(starts, ["length", "salt"])
    ranked = ranked.select(*PIECES.names, (F.col("rank") + F.col("ahead")).alias("rank"))
    shift = 1 << 44

    def place(batches):
        keys = plan[:, 0] * shift + plan[:, 1]
        for b in batches:
            length, rank = (b.column(n).to_numpy() for n in ("length", "rank"))
            row = plan[np.searchsorted(keys, length * shift + rank, "right") - 1]
            k = rank - row[:, 1]
            sequence, offset = row[:, 3] + k // row[:, 2], row[:, 4] + k % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(b.column(n).cast(PIECES.field(n).type) for n in PIECES.names), pa.array(sequence), pa.array(offset)], schema=PLACED)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
