"""Long repeats across documents: windows are met by content-defined anchors, compared group by group.

A window of ``length`` tokens holds ``length - k + 1`` runs of k tokens; the one with the
least hash (the leftmost of equals) is its anchor. Equal windows have equal anchors in
the same place, so only windows with the same anchor have to be compared, and an
anchor that occurs once needs no comparison at all. Consecutive windows mostly share
an anchor and travel as one stretch of text. A unit may ask for windows of two lengths:
the anchors of the longer ones are among those of the shorter, so both travel as one. Each task lets a stretch (or, of a common
anchor, a window) through once, however often it has it, so that a passage in very
many documents is settled where it is read.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embspark.llm.common import checkpoint, encoded, slices, to_batch, width

#: An anchor found more often than this is not one group: its windows go each by itself, under 128 bits of hash.
HOT = 20_000
#: Tokens hashed at once; positions among them take POSITION bits of an anchor's rank.
STEP, POSITION = 1 << 20, 22
#: Bytes of text that a task turns into tokens at once.
TEXT_BYTES = 2 << 20
#: Windows compared at once (a group is never cut).
CHUNK = 300_000
#: Bytes of stretches, and windows of common anchors, that a task holds before it lets them through.
HELD_BYTES, HELD_WINDOWS = 32 << 20, 500_000

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
#: What sets windows of one length apart from those of another.
LEVEL = 0x5851F42D4C957F2D
ANCHOR = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("times", pa.int64())])
#: ``level`` -1: a stretch, with the windows of either length that begin in it (``lo``, ``n``); else a window by its hash, or a settled range (``n`` -1).
STRETCH = pa.schema([
    ("anchor", pa.int64()), ("whole", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
    ("level", pa.int32()), ("at", pa.int32()), ("lo", pa.int32()), ("n", pa.int32()), ("lo2", pa.int32()), ("n2", pa.int32()), ("tokens", pa.binary()),
])
STRETCH_DDL = "anchor long, whole long, doc_id long, start long, level int, at int, lo int, n int, lo2 int, n2 int, tokens binary"
SPAN = pa.schema([("level", pa.int32()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
#: The column that texts get beside their own, whatever these are called.
SPANS, SPANS_DDL = "__spans", "array<struct<level:int,lo:bigint,hi:bigint>>"
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", UNBASE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def run_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive tokens."""
    up, down = powers(len(tokens))
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(tokens) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    room = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    front = np.minimum.accumulate(room, axis=1).ravel()
    back = np.minimum.accumulate(room[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(back[:n], front[w - 1 : w - 1 + n])


def anchored_runs(tokens: np.ndarray, ends: np.ndarray, length: int, k: int, step: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For documents laid end to end: document, first window, number of windows, anchor's place after it, anchor's hash."""
    starts = np.r_[0, ends[:-1]]
    low = np.uint64((1 << POSITION) - 1)
    for at in range(0, len(tokens), step):
        part = tokens[at : at + step + length - 1]
        if len(part) < length:
            return
        h = run_hashes(part, k)
        best = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - k + 1) & low
        # the document in which a window starts must be that in which it ends
        doc = np.searchsorted(ends, np.arange(at, at + len(best)), "right")
        inside = np.flatnonzero(np.arange(at, at + len(best)) + length <= ends[doc])
        if not len(inside):
            continue
        b = best[inside]
        cut = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (np.diff(inside) != 1)])
        first, n = inside[cut], np.diff(np.r_[cut, len(inside)])
        d, anchor = doc[first], b[cut].astype(np.int64)
        yield d, first + at - starts[d], n, anchor - first, h[anchor].view(np.int64)


def wide_hashes(tokens: np.ndarray, length: int, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the windows that begin at ``at`` (ascending)."""
    out = np.empty((2, len(at)), np.int64)
    for lo in range(0, len(tokens), step):
        own = slice(*np.searchsorted(at, (lo, lo + step)))
        if own.start == own.stop:
            continue
        part = tokens[lo : lo + step + length - 1]
        for k, t in enumerate((part, (part ^ part >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25))):
            out[k, own] = run_hashes(t, length).view(np.int64)[at[own] - lo]
    return out[0], out[1]


class Unit(ABC):
    """What the text consists of, and how the windows of a group are compared.

    ``levels``: one or two lengths of windows, each with ``keep_first``: of equal windows the first (by doc_id, then place) stays; else none.
    """

    levels: list[tuple[int, bool]]
    k: int

    @property
    def shortest(self) -> int:
        """Number of the level whose windows give the anchors."""
        return min(range(len(self.levels)), key=lambda j: self.levels[j][0])

    @property
    def lengths(self) -> np.ndarray:
        return np.array([x for x, _ in self.levels])

    @property
    def keeps(self) -> np.ndarray:
        return np.array([x for _, x in self.levels])

    @abstractmethod
    def tokens(self, text: bytes) -> np.ndarray:
        """64-bit tokens of a text."""

    @abstractmethod
    def packed(self, text: bytes, tokens: np.ndarray):
        """The text so that ``[i:j]`` gives tokens i to j as bytes."""

    @abstractmethod
    def classes(self, rows: "Stretches") -> list[np.ndarray]:
        """For each level, a number for every window of every row, equal for equal windows of one group and for no others."""


class Stretches:
    """Rows of whole groups: ``group``, anchor ``at``, ``tokens`` bytes, and by level the first window ``lo`` and their number ``n``."""

    def __init__(self, group, at, lo, n, tokens):
        self.group, self.at, self.lo, self.n, self.tokens = group, at, lo, n, tokens


def text_tokens(unit: Unit, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Tokens of each text, all end to end, and where each ends."""
    tokens = [unit.tokens(t) for t in texts]
    return tokens, tokens[0] if len(tokens) == 1 else np.concatenate(tokens), np.cumsum([len(t) for t in tokens])


def anchored(unit: Unit, level: int, flat: np.ndarray, ends: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows, anchor's place in the document, anchor's hash; one row an anchor."""
    found = list(anchored_runs(flat, ends, unit.levels[level][0], unit.k, step))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    d, first, n, at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    # a run that was cut where a part of the text ends
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (np.diff(first + at) != 0)])
    return d[new], first[new], np.add.reduceat(n, new), (first + at)[new], h[new]


def nested(unit: Unit, flat: np.ndarray, ends: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """As ``anchored`` for the shortest windows; first windows and their numbers have a column for each level."""
    base = unit.shortest
    d, first, n, place, h = anchored(unit, base, flat, ends, step)
    firsts, counts = (np.zeros((len(d), len(unit.levels)), np.int64) for _ in range(2))
    firsts[:, base], counts[:, base] = first, n
    starts = np.r_[0, ends[:-1]]
    for j in range(len(unit.levels)):
        if j != base and len(d):
            e, first, n, p, _ = anchored(unit, j, flat, ends, step)
            row = np.searchsorted(starts[d] + place, starts[e] + p)
            firsts[row, j], counts[row, j] = first, n
    return d, firsts, counts, place, h


def anchor_table(docs: DataFrame, unit: Unit) -> DataFrame:
    """``anchor, doc_id, times``: the anchors of each document and how often it has them in succession."""
    step = STEP

    def run(batches):
        for part in slices(batches, most=TEXT_BYTES):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            _, flat, ends = text_tokens(unit, encoded(part.column("text")))
            d, _, _, _, h = anchored(unit, unit.shortest, flat, ends, step)
            if len(d):
                first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
                yield to_batch(ANCHOR, anchor=h[first], doc_id=ids[d[first]], times=np.diff(np.r_[first, len(h)]))

    return docs.mapInArrow(run, "anchor long, doc_id long, times long")


class Survivors:
    """What a task has found in its texts: each stretch once, each window of a common anchor once; the others are settled.

    Of equal ones the first goes on. Where none may stay, all of them are settled, and the first goes on to meet those of other tasks.
    """

    def __init__(self, unit: Unit, most_bytes: int, most_windows: int):
        self.unit, self.most_bytes, self.most_windows = unit, most_bytes, most_windows
        self.clear()

    def clear(self) -> None:
        self.index: dict[tuple, list] = {}
        self.windows: list[np.ndarray] = []
        self.settled: list[tuple[int, int, int, int]] = []
        self.held = self.n_windows = 0

    @property
    def full(self) -> bool:
        return self.held > self.most_bytes or self.n_windows > self.most_windows

    def stretch(self, anchor: int, doc: int, start: int, at: int, ranges: tuple[int, ...], tokens: bytes) -> None:
        """``ranges``: first window and number of windows of each level, counted from ``start``."""
        key = (anchor, at, ranges, tokens)
        found = self.index.get(key)
        if found is None:
            self.index[key] = [doc, start, False]
            self.held += len(tokens) + 400
            return
        first, own = (found[0], found[1]), (doc, start)
        if first == own:  # from a repeated row of the table
            return
        for level, (length, keep) in enumerate(self.unit.levels):
            lo, n = ranges[2 * level : 2 * level + 2]
            if n:
                told = [max(first, own)] if keep else [own] if found[2] else [first, own]
                self.settled += [(level, d, s + lo, s + lo + n + length - 1) for d, s in told]
                self.held += 200
        found[:] = [*min(first, own), True]

    def common(self, level: int, doc: np.ndarray, start: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        self.windows.append(np.stack([one ^ np.int64(level * LEVEL), two, doc, start, np.full(len(doc), level)]))
        self.n_windows += len(doc)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.index:
            keys, places = list(self.index), list(self.index.values())
            anchor, at, ranges, tokens = zip(*keys, strict=True)
            doc, start, _ = zip(*places, strict=True)
            lo, n, *second = np.array(ranges).T
            lo2, n2 = second or (np.zeros_like(lo), np.zeros_like(n))
            yield to_batch(STRETCH, anchor=anchor, whole=[0] * len(n), doc_id=doc, start=start, level=[-1] * len(n), at=at, lo=lo, n=n, lo2=lo2, n2=n2, tokens=tokens)
        gone = [np.array(self.settled, np.int64).reshape(-1, 4)]
        if self.windows:
            cols = np.concatenate(self.windows, axis=1)
            cols = cols[:, np.lexsort(cols[3::-1])]
            cols = cols[:, np.r_[True, (cols[:4, 1:] != cols[:4, :-1]).any(axis=0)]]
            again = np.r_[False, (cols[:2, 1:] == cols[:2, :-1]).all(axis=0)]
            yield bare_rows(*cols[:, ~again], n=1)
            keep = self.unit.keeps[cols[4]]
            gone.append(joined_windows(cols[2:, again | (~keep & np.r_[again[1:], False])], self.unit.lengths))
        gone = joined_ranges(np.concatenate(gone))
        if len(gone):
            level, doc, lo, hi = gone.T
            yield bare_rows(doc + lo, hi, doc, lo, level, n=-1)
        self.clear()


def bare_rows(anchor: np.ndarray, whole: np.ndarray, doc: np.ndarray, start: np.ndarray, level: np.ndarray, n: int) -> pa.RecordBatch:
    none = np.zeros(len(doc), np.int32)
    return to_batch(STRETCH, anchor=anchor, whole=whole, doc_id=doc, start=start, level=level, at=none, lo=none, n=none + n, lo2=none, n2=none, tokens=[b""] * len(doc))


def joined_ranges(rows: np.ndarray) -> np.ndarray:
    """Rows level, doc, lo, hi; those of one document that touch are one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    level, doc, lo, hi = rows.T
    group = np.cumsum(np.r_[True, (level[1:] != level[:-1]) | (doc[1:] != doc[:-1])])
    # the farthest end so far, group by group: groups are set apart by more than any place
    apart = group * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + apart)
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (lo[1:] + apart[1:] > reach[:-1])])
    last = np.r_[first[1:], len(rows)] - 1
    return np.stack([level[first], doc[first], lo[first], reach[last] - apart[last]], axis=1)


def joined_windows(cols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows level, doc, lo, hi of windows (doc, start, level); those in succession are one."""
    doc, start, level = cols[:, np.lexsort((cols[1], cols[0], cols[2]))]
    if not len(doc):
        return np.zeros((0, 4), np.int64)
    first = np.flatnonzero(np.r_[True, (level[1:] != level[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(start) > 1)])
    last = np.r_[first[1:], len(doc)] - 1
    return np.stack([level[first], doc[first], start[first], start[last] + lengths[level[first]]], axis=1)


def stretch_table(docs: DataFrame, unit: Unit) -> DataFrame:
    """The stretches of text around anchors that occur more than once; windows of common anchors one by one, by hash.

    A settled range of the text goes from ``start`` to ``whole``. Anchors are counted by
    partial sums, and the counts come back in a join that may be split where an anchor is common.
    """
    anchors = anchor_table(docs, unit)
    counts = anchors.groupBy("anchor").agg(F.sum("times").alias("seen")).where("seen > 1")
    counts = checkpoint(counts.select("anchor", (F.col("seen") > HOT).alias("hot")))
    again = anchors.select("anchor", "doc_id").join(counts, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "hot")).alias("again"))
    step, most = STEP, (HELD_BYTES, HELD_WINDOWS)

    def run(batches):
        kept = Survivors(unit, *most)
        lengths = unit.lengths
        for part in slices(batches, most=TEXT_BYTES):
            texts = encoded(part.column("text"))
            ids = part.column("doc_id").to_numpy()
            lists = part.column("again")
            of = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
            wanted = mixed(lists.flatten().field("anchor").to_numpy(), of)
            order = np.argsort(wanted)
            wanted, is_hot = wanted[order], lists.flatten().field("hot").to_numpy(zero_copy_only=False)[order]
            tokens, flat, ends = text_tokens(unit, texts)
            d, firsts, counts, place, h = nested(unit, flat, ends, step)
            if not len(d):
                continue
            base = np.r_[0, ends[:-1]]
            own = mixed(h, d)
            k = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            found = wanted[k] == own
            hot = found & is_hot[k]
            for level, length in enumerate(lengths.tolist()):
                first, n, doc = firsts[hot, level], counts[hot, level], d[hot]
                if n.any():
                    a, c = np.repeat(doc, n), np.repeat(first, n)
                    c += np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
                    kept.common(level, ids[a], c, *wide_hashes(flat, length, base[a] + c, step))
            cold = np.flatnonzero(found & ~hot)
            first, n, some = firsts[cold], counts[cold], counts[cold] > 0
            lo = np.where(some, first, np.iinfo(np.int64).max).min(axis=1)
            hi = np.where(some, first + n + lengths - 1, 0).max(axis=1)
            ranges = np.stack([np.where(some, first - lo[:, None], 0), n], axis=2).reshape(len(cold), 2 * len(lengths))
            now, packed = -1, None
            for doc, a, b, at, anchor, parts in zip(d[cold].tolist(), lo.tolist(), hi.tolist(), (place[cold] - lo).tolist(), h[cold].tolist(), ranges.tolist(), strict=True):
                if doc != now:
                    now, packed = doc, unit.packed(texts[doc], tokens[doc])
                kept.stretch(anchor, int(ids[doc]), a, at, tuple(parts), packed[a:b])
            if kept.full:
                yield from kept.rows()
        yield from kept.rows()

    return docs.join(again, "doc_id").mapInArrow(run, STRETCH_DDL)


def mixed(anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One number for an anchor in a document of the batch."""
    return anchor.view(np.uint64) ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


class Cold:
    """Rows of anchors that are compared as a group, held until their group is whole."""

    def __init__(self, unit: Unit, chunk: int):
        self.unit, self.chunk, self.held, self.windows = unit, chunk, [], 0

    def push(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        sums = np.cumsum(batch.column("n").to_numpy().astype(np.int64) + batch.column("n2").to_numpy())
        while at < batch.num_rows:
            done = sums[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sums, done + self.chunk)))
            self.held.append(batch.slice(at, to - at))
            self.windows += int(sums[min(to, batch.num_rows) - 1] - done)
            at = to
            if self.windows >= self.chunk:
                yield from self.flush(last=False)

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        table = pa.Table.from_batches(self.held)
        key = table.column("anchor").to_numpy()
        n = table.num_rows
        if not last:
            other = np.flatnonzero(key != key[-1])
            n = int(other[-1]) + 1 if len(other) else 0
        if n:
            yield from self.compare(table.slice(0, n))
        rest = table.slice(n)
        self.held = rest.to_batches()
        self.windows = int(rest.column("n").to_numpy().sum() + rest.column("n2").to_numpy().sum()) if rest.num_rows else 0

    def compare(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, doc, start = (table.column(c).to_numpy() for c in ("anchor", "doc_id", "start"))
        fresh = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])]  # a repeated row of the table is the same document
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]])
        own = np.flatnonzero(fresh & (np.bincount(group, fresh)[group] > 1))
        if not len(own):
            return
        part, doc, start = table.take(pa.array(own)), doc[own], start[own]
        lo, n = ([part.column(c).to_numpy().astype(np.int64) for c in names[: len(self.unit.levels)]] for names in (("lo", "lo2"), ("n", "n2")))
        rows = Stretches(group[own], part.column("at").to_numpy().astype(np.int64), lo, n, part.column("tokens").to_pylist())
        for level, (classes, (length, keep)) in enumerate(zip(self.unit.classes(rows), self.unit.levels, strict=True)):
            where = np.flatnonzero(repeated(classes, keep))
            if len(where):
                row = np.repeat(np.arange(len(doc)), n[level])
                window = np.arange(len(row)) - np.repeat(np.cumsum(n[level]) - n[level], n[level]) + lo[level][row]
                cut = np.flatnonzero(np.r_[True, (np.diff(where) != 1) | (np.diff(row[where]) != 0)])
                ends = np.r_[cut[1:], len(where)] - 1
                at = row[where[cut]]
                yield spans(np.full(len(at), level), doc[at], start[at] + window[where[cut]], start[at] + window[where[ends]] + length)


def repeated(classes: np.ndarray, keep_first: bool) -> np.ndarray:
    """True where a class has another member, or with ``keep_first`` an earlier one."""
    order = np.argsort(classes, kind="stable")
    c = classes[order]
    same = c[1:] == c[:-1]
    flag = np.zeros(len(c), bool)
    flag[order[1:][same]] = True
    if not keep_first:
        flag[order[:-1][same]] = True
    return flag


def spans(level: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return to_batch(SPAN, level=level, doc_id=doc, lo=lo, hi=hi)


class Hot:
    """Windows of common anchors, sorted by hash and place: equal ones are neighbours, so one row is held."""

    def __init__(self, unit: Unit):
        self.keep, self.length = unit.keeps, unit.lengths
        self.last, self.given = None, False

    def push(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("anchor", "whole", "doc_id", "start", "level")])
        held = self.last is not None
        if held:
            cols = np.concatenate([self.last, cols], axis=1)
        cols = cols[:, np.r_[True, (cols[:, 1:] != cols[:, :-1]).any(axis=0)]]
        same = (cols[:2, 1:] == cols[:2, :-1]).all(axis=0)
        flag = np.r_[False, same] | (np.r_[same, False] & ~self.keep[cols[4]])
        if held:
            flag[0] = not self.given and bool(same[:1].any()) and not self.keep[cols[4, 0]]
        self.given = bool(flag[-1]) or (held and cols.shape[1] == 1 and self.given)
        self.last = cols[:, -1:]
        _, _, doc, start, level = cols[:, flag]
        return spans(level.astype(np.int32), doc, start, start + self.length[level])


def removed_spans(docs: DataFrame, unit: Unit) -> DataFrame:
    """``doc_id, spans``: token ranges covered by windows that occur elsewhere (``keep_first``: earlier), by the number of the level.

    ``docs(doc_id, text)`` without null ids. Earlier means a smaller id, or an earlier start in the same text.
    """
    dealt = stretch_table(docs, unit).repartition(width(docs), "anchor", "whole").sortWithinPartitions("anchor", "whole", "doc_id", "start")
    chunk = CHUNK

    def run(batches):
        cold, hot = Cold(unit, chunk), Hot(unit)
        for b in batches:
            level, n = b.column("level").to_numpy(), b.column("n").to_numpy()
            for chosen, settled in ((n < 0, True), ((level >= 0) & (n > 0), False)):
                if chosen.any():
                    rows = b.filter(pa.array(chosen))
                    yield spans(*(rows.column(c).to_numpy() for c in ("level", "doc_id", "start", "whole"))) if settled else hot.push(rows)
            if (level < 0).any():
                yield from cold.push(b.filter(pa.array(level < 0)))
        yield from cold.flush(last=True)

    found = dealt.mapInArrow(run, "level int, doc_id long, lo long, hi long")
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("level", "lo", "hi")).alias("spans"))


def merged(ranges: list[dict] | None, most: int, level: int = 0) -> list[tuple[int, int]]:
    """Disjoint ascending ranges of one level within ``most`` tokens; ranges that touch are one."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], min(r["hi"], most)) for r in ranges or () if r["level"] == level):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif lo < hi:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def with_spans(docs: DataFrame, unit: Unit) -> DataFrame:
    """``docs`` with SPANS. Rows without an id take no part and have none."""
    named = docs.where("doc_id is not null")
    found = named.join(removed_spans(named.select("doc_id", "text"), unit).withColumnRenamed("spans", SPANS), "doc_id", "left")
    return found.select(*docs.columns, SPANS).unionByName(docs.where("doc_id is null").withColumn(SPANS, F.lit(None).cast(SPANS_DDL)))
