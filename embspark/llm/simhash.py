"""Near-duplicate documents by SimHash: bit-sliced comparison inside buckets of equal bits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embspark.llm.common import checkpoint, documents, encoded, slices, to_batch, width
from embspark.llm.components import components

PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
ROW = ["mask", "key", "fp", "node"]
#: A bucket with more fingerprints than this is split by further bits, unless no more than FREE bits are left.
BUCKET, FREE = 4096, 12
#: Rows of one part of a group of candidates whose sets are compared; rows that are broadcast at most (two or three longs each).
TILE, BROADCAST_ROWS = 1024, 100_000
#: Bytes of rows with sets that are held at once, if no tile is larger.
SET_BYTES = 64 << 20
#: Shingles hashed at once.
SHINGLES = 1 << 16
#: Bit planes that are summed between two looks at which blocks are still within the radius.
PLANES = 8
#: Blocks of 64 pairs compared at once.
BLOCKS = 8192
FULL = (1 << 64) - 1
#: For a byte, a word whose bytes are the byte's bits; up to 255 of them add up without overflow.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(words: list[bytes], shingle: int, seed: int = 42) -> int:
    """Bit k is set if it is in over half of the XXH64 values of the text's word shingles."""
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(join(words), seed=seed)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        part = words[at : at + SHINGLES + shingle - 1]
        hashes = np.fromiter((digest(join(s), seed=seed) for s in zip(*(part[k:] for k in range(shingle)), strict=False)), np.uint64, len(part) - shingle + 1)
        counts = np.add.reduceat(SPREAD[hashes.view(np.uint8).reshape(-1, 8)], np.arange(0, len(hashes), 255), axis=0)
        bits += counts.view(np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) of each row; words are lower-cased (A-Z)."""

    def run(batches):
        for part in slices(batches):
            fps = [fingerprint(t.lower().split(), shingle) for t in encoded(part.column("text"))]
            yield to_batch(PRINT, doc_id=part.column("doc_id"), fp=np.array(fps, np.uint64).view(np.int64))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def split_bits(free: int, parts: int) -> list[int]:
    """Masks that deal the set bits of ``free`` into ``parts`` runs."""
    bits = [k for k in range(64) if free >> k & 1]
    cuts = [len(bits) * p // parts for p in range(parts + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def first_masks(radius: int) -> list[int]:
    """Bits of which some mask's must all be equal if two fingerprints are within ``radius``: two of radius + 2 runs."""
    return [a | b for a, b in combinations(split_bits(FULL, radius + 2), 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes of fingerprints (rows of one or more words): a plane holds one bit of all of them, 64 to a word."""
    fps = fps.reshape(len(fps), -1)
    room = np.zeros((-len(fps) % 64, fps.shape[1]), np.uint64)
    bits = np.unpackbits(np.concatenate([fps, room]).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: bitwise sum of three, as carries and ones."""
    odd = a ^ b
    return (a & b) | (odd & c), odd ^ c


def near_words(planes: np.ndarray, at: np.ndarray, lags: np.ndarray, alive: np.ndarray, radius: int) -> np.ndarray:
    """For each block (word ``at`` of the planes, a lag, bits of the rows to look at): bits set where rows i and i + lag differ in ``radius`` bits at most.

    The differing bits of all planes are added up in carry-save bitwise counters, eight planes
    at a time and for many lags at once; a block leaves as soon as all of its rows are beyond the radius.
    """
    n = planes.shape[1]
    out = np.zeros(len(at), np.uint64)
    live, still = np.arange(len(at)), alive
    ahead = np.minimum(at + lags // 64, n - 1)
    after = np.minimum(ahead + 1, n - 1)
    shift = (lags % 64).astype(np.uint64)
    back, one = np.uint64(63) - shift, np.uint64(1)
    counters = [np.zeros(len(at), np.uint64) for _ in range(max(3, radius.bit_length() + 1))]
    over = np.zeros(len(at), np.uint64)
    for first in range(0, len(planes), PLANES):
        d = [p[at] ^ ((p[ahead] >> shift) | ((p[after] << one) << back)) for p in planes[first : first + PLANES]]
        ones, twos, fours, *higher = counters
        a, ones = csa(ones, d[0], d[1])
        b, ones = csa(ones, d[2], d[3])
        c, twos = csa(twos, a, b)
        a, ones = csa(ones, d[4], d[5])
        b, ones = csa(ones, d[6], d[7])
        e, twos = csa(twos, a, b)
        carry, fours = csa(fours, c, e)
        for x in higher:
            x ^= carry
            carry = carry & ~x
        over |= carry
        counters = [ones, twos, fours, *higher]
        still = still & ~(over | beyond(counters, radius))
        keep = still != 0
        if not keep.all():
            live, still, at, ahead, after, shift, back, over = (x[keep] for x in (live, still, at, ahead, after, shift, back, over))
            counters = [c[keep] for c in counters]
        if not len(live):
            return out
    out[live] = still
    return out


def within(planes: np.ndarray, lag: int, alive: np.ndarray, radius: int) -> np.ndarray:
    """Words of a bit mask: set where rows i and i + lag differ in ``radius`` bits at most; ``alive`` are those to look at."""
    out = np.zeros(planes.shape[1], np.uint64)
    at = np.flatnonzero(alive)
    out[at] = near_words(planes, at, np.full(len(at), lag), alive[at], radius)
    return out


def beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bitwise: counter > radius, most significant bit first."""
    more = np.zeros_like(counters[0])
    equal = ~more
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more |= equal & counters[k]
            equal = equal & ~counters[k]
    return more


class Forest:
    """Union-find over rows; only links that join two trees are given out."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        up = np.array(self.up, np.int64)
        while (up[up] != up).any():
            up = up[up]
        return up


def lag_blocks(group: np.ndarray, tree: np.ndarray, guest: np.ndarray, lags: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Words, lags and bits of the pairs to compare, of one group but two trees and not both guests, for as many ``lags`` as make up BLOCKS; the next lag."""
    words, own, alive, held, lag = [], [], [], 0, lags.start
    for lag in lags:
        pairs = (group[lag:] == group[:-lag]) & (tree[lag:] != tree[:-lag]) & ~(guest[lag:] & guest[:-lag])
        bits = np.packbits(pairs, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view("<u8")
        at = np.flatnonzero(bits)
        words.append(at)
        own.append(np.full(len(at), lag))
        alive.append(bits[at])
        held += len(at)
        if held >= BLOCKS:
            break
    return np.concatenate(words), np.concatenate(own), np.concatenate(alive), lag + 1


def bucket_links(
    fps: np.ndarray, group: np.ndarray, radius: int, confirm: Callable[[int, int], bool] | None = None, label: np.ndarray | None = None, guest: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (i, j) of equal ``group`` (rows sorted by it) within the radius, and confirmed.

    All pairs of a group are compared but those whose rows one tree holds already; rows of
    equal ``label`` are one tree from the start. Two rows that are both a ``guest`` are compared elsewhere.
    """
    out, forest = [], Forest(len(fps))
    if not len(fps):
        return out
    guest = np.zeros(len(fps), bool) if guest is None else guest
    tree = np.arange(len(fps))
    if label is not None:
        _, at, own = np.unique(np.stack([group, label]), axis=1, return_index=True, return_inverse=True)
        forest.up = at[own.ravel()].tolist()
        tree = forest.roots()
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    kept, lag, end = None, 1, 1
    while True:
        if lag == end:  # again and again only the rows of large enough buckets
            # a bucket that is one tree has nothing more to say
            big = (sizes > lag) & (np.minimum.reduceat(tree, starts) != np.maximum.reduceat(tree, starts))
            if not big.any():
                return out
            kept = np.flatnonzero(np.repeat(big, sizes))
            base, own, end = planes_of(fps[kept]), group[kept], 2 * lag
        if lag >= len(kept):
            return out
        at, lags, alive, lag = lag_blocks(own, tree[kept], guest[kept], range(lag, min(end, len(kept))))
        found = near_words(base, at, lags, alive, radius)
        some = np.flatnonzero(found)
        if len(some):
            k, bit = np.nonzero(np.unpackbits(found[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            first = 64 * at[some[k]] + bit
            for a, b in zip(kept[first].tolist(), kept[first + lags[some[k]]].tolist(), strict=True):
                if forest.root(a) != forest.root(b) and (confirm is None or confirm(a, b)):
                    forest.link(a, b)
                    out.append((a, b))
            tree = forest.roots()


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Sorted rows (mask, key, fp, node), no row twice, so that no group of equal mask and key is cut."""
    held = np.zeros((0, 4), np.int64)
    for b in batches:
        held = np.concatenate([held, np.stack([b.column(n).to_numpy() for n in ROW], axis=1)])
        other = np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1))
        tail = int(other[-1]) + 1 if len(other) else 0
        if tail:
            yield without_repeats(held[:tail])
            held = held[tail:]
    if len(held):
        yield without_repeats(held)


def without_repeats(rows: np.ndarray) -> np.ndarray:
    return rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]


def wider_masks(masks: list[int], radius: int) -> dict[int, list[int]]:
    """For each mask with more than FREE bits left, those that also hold one of radius + 1 runs of the free bits; one of them has no differing bit."""
    return {m: [m | more for more in split_bits(FULL & ~m, radius + 1)] for m in masks if (FULL & ~m).bit_count() > FREE}


def buckets(prints: DataFrame, radius: int) -> DataFrame:
    """``mask, key, fp, node``: the rows of ``prints(fp, node)`` in buckets of equal bits, BUCKET rows or 2 ** FREE at most.

    Two fingerprints within the radius agree on some two of radius + 2 runs of bits, so
    each is put into a bucket for every two runs. The rows of larger buckets go on under
    masks with one more run of their free bits, until few bits are left: a bucket of
    different fingerprints is then small by itself. Sizes are partial sums, so a large bucket is never one task's.
    """
    spark, masks = prints.sparkSession, first_masks(radius)
    key = F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    rows = prints.select(F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"), "fp", "node").select("mask", key, "fp", "node")
    done = None
    while wider := wider_masks(masks, radius):
        sizes = rows.where(F.col("mask").isin([signed(m) for m in wider])).groupBy("mask", "key").count()
        large = checkpoint(sizes.where(F.col("count") > BUCKET).select("mask", "key"))
        n = large.count()
        if not n:
            break
        if n <= BROADCAST_ROWS:
            large = F.broadcast(large)
        kept = rows.join(large, ["mask", "key"], "left_anti")
        done = kept if done is None else done.union(kept)
        more = spark.createDataFrame([(signed(m), signed(w)) for m, ws in wider.items() for w in ws], "mask long, wider long")
        # a few dozen masks
        rows = rows.join(large, ["mask", "key"]).join(F.broadcast(more), "mask").select(F.col("wider").alias("mask"), "fp", "node").select("mask", key, "fp", "node")
        rows = checkpoint(rows)
        masks = sorted({w for ws in wider.values() for w in ws})
    return rows if done is None else done.union(rows)


def print_links(prints: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links that connect all different fingerprints within ``radius``; ``prints(fp, node)``, one row each."""

    def run(batches):
        for rows in whole_groups(batches):
            group = np.cumsum(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            found = bucket_links(rows[:, 2].view(np.uint64), group, radius)
            if found:
                a, b = np.array(found).T
                yield to_batch(LINK, a=rows[a, 3], b=rows[b, 3])

    dealt = buckets(prints, radius).repartition(width(prints), "mask", "key").sortWithinPartitions(*ROW)
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs(doc_id, text, ...)``.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked;
    ``component_id`` is the smallest id reachable. Fewer words than ``shingle``: one
    shingle of them all; none (null, empty): fingerprint zero, linked like any other.
    Equal fingerprints are one node from the start, so groups of copies are never
    expanded. Null ids have a fingerprint and the component of the other documents
    linked to them (null if there is none); repeated rows each give a row.
    """
    prints = checkpoint(fingerprints(docs, shingle))
    # a group of null ids alone still needs a node: ids are >= 0 in practice, others are kept apart by the flag
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null")
    joined = components(print_links(checkpoint(nodes), radius))
    named = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp", "left").select("doc_id", text, "component_id")


SKETCH = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary()), ("keys", pa.list_(pa.int64())), ("digest", pa.int64())])


def lane_hashes(hashes: np.ndarray, lanes: int) -> Iterator[np.ndarray]:
    """Further 64-bit hashes of the same shingles."""
    for lane in range(lanes):
        h = hashes * np.uint64(2 * xxhash.xxh64_intdigest(b"lane", seed=lane) % (1 << 64) | 1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        yield h


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each different shingle; a zero if there is no word."""
    if not words:
        return np.zeros(1, np.uint64)
    join = b" ".join
    grams = {join(words)} if len(words) <= shingle else set(map(join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams))


def sketch(words: list[bytes], shingle: int, lanes: int, tables: int) -> tuple[bytes, list[int]]:
    """A wide fingerprint of the set of shingles, and keys: each table's least two hashes over the set, as one."""
    hashes = shingle_hashes(words, shingle)
    at = np.arange(0, len(hashes), 255)
    bits = []
    keys = []
    for lane, h in enumerate(lane_hashes(hashes, max(lanes, 2 * tables))):
        if lane < lanes:
            counts = np.add.reduceat(SPREAD[h.view(np.uint8).reshape(-1, 8)], at, axis=0)
            bits.append(2 * counts.view(np.uint8).sum(axis=0, dtype=np.int64) > len(hashes))
        if lane < 2 * tables:
            keys.append(int(h.min()))
    pairs = [signed((a * 0x9E3779B97F4A7C15 + b + t) & FULL) for t, (a, b) in enumerate(zip(keys[::2], keys[1::2], strict=True))]
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes(), pairs


def radius_of(similarity: float, bits: int) -> int:
    """Differing bits expected of two shingle sets with this Jaccard similarity."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def candidate_radius(similarity: float, bits: int) -> int:
    """Differing bits that two shingle sets of this similarity have at most, by six standard deviations."""
    mean = radius_of(similarity, bits)
    return round(mean + 6 * math.sqrt(mean * (1 - mean / bits)))


def whole_tiles(batches: Iterator[pa.RecordBatch], key: str, full: Callable[[pa.Table], bool]) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` and tile, given out when ``full`` so that no tile is cut."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if not full(held):
            continue
        group = tile_numbers(held, key)
        n = int(np.searchsorted(group, group[-1]))
        if n:
            yield held.slice(0, n)
            held = held.slice(n)
    if held is not None and held.num_rows:
        yield held


def tile_numbers(rows: pa.Table, key: str) -> np.ndarray:
    keys, tile = rows.column(key).to_numpy(), rows.column("tile").to_numpy()
    return np.cumsum(np.r_[True, (keys[1:] != keys[:-1]) | (tile[1:] != tile[:-1])])


def with_parts(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` with ``parts``: into how many parts the rows of equal ``key`` are cut so that none is much above ``most`` rows."""
    sizes = checkpoint(rows.groupBy(key).count().where(F.col("count") > most))
    if sizes.isEmpty():
        return rows.withColumn("parts", F.lit(1).cast("long"))
    return rows.join(sizes, key, "left").withColumn("parts", F.coalesce(F.ceil(F.col("count") / most), F.lit(1)).cast("long")).drop("count")


def linked_in_parts(rows: DataFrame, key: str, most: int, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a, b``: links that ``find`` has inside the groups of equal ``key`` of ``rows(key, node, ...)``.

    Groups above ``most`` rows are cut into parts, in two ways that have nothing to do with
    each other. First each part is linked by itself; together the two cuts make one tree
    of a group of near copies. Then only the rows outside a group's largest tree visit its other parts, as
    guests, to be compared with the rows of other trees there: no pair is left out but
    those that a tree holds already, and rows of the largest tree are never copied.
    ``find`` gets ``label`` (a tree's number) and ``tiles`` (part, guest) beside the columns of ``rows``.
    """
    parted = with_parts(rows, key, most)
    own, other = (F.pmod(F.xxhash64(F.lit(k), key, "node"), F.col("parts")) for k in (0, 1))
    place = lambda tile, guest: F.struct(tile.alias("tile"), guest.alias("guest"))
    once = F.array(place(own, F.lit(False)))
    twice = F.array(place(own, F.lit(False)), place(F.col("parts") + other, F.lit(False)))
    links = checkpoint(find(parted.select(*rows.columns, F.col("node").alias("label"), F.when(F.col("parts") == 1, once).otherwise(twice).alias("tiles"))))
    large = parted.where("parts > 1")
    if large.isEmpty():
        return links
    trees = checkpoint(components(links).select("node", F.col("component").alias("label")))
    large = large.join(trees, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = large.groupBy(key, "label").count()
    main = checkpoint(sizes.groupBy(key).agg(F.max_by("label", "count").alias("main"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # one row for each group above ``most`` rows that is not one tree yet
    if main.count() <= BROADCAST_ROWS:
        main = F.broadcast(main)
    everywhere = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda t: place(t, t != own))
    tiles = F.when(F.col("label") == F.col("main"), once).otherwise(everywhere).alias("tiles")
    return links.union(find(large.join(main, key).select(*rows.columns, "label", tiles)))


def tile_rows(rows: DataFrame, key: str) -> DataFrame:
    """A row for each tile, dealt and sorted so that tiles are whole."""
    names = [c for c in rows.columns if c != "tiles"]
    each = rows.select(*names, F.explode("tiles").alias("t")).select(*names, "t.tile", "t.guest")
    return each.repartition(width(rows), key, "tile").sortWithinPartitions(key, "tile", "node")


def similar_sets(docs: DataFrame, groups: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """``a, b``: links by the exact similarity of the shingle sets; ``groups(node, digest, fp, component)``.

    The pairs of a component within ``radius`` are compared set by set, but those that
    confirmed links connect already; components above TILE rows are compared in parts.
    """

    def draw(batches):
        for part in slices(batches):
            sets = [np.unique(shingle_hashes(t.lower().split(), shingle)).tobytes() for t in encoded(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "hashes"])

    def run(batches):
        for rows in whole_tiles(batches, "component", lambda held: held.nbytes > SET_BYTES):
            node, label, guest = (rows.column(c).to_numpy() for c in ("node", "label", "guest"))
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
            fps = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(len(sets), -1)

            def alike(i, j):
                small, large = sorted((len(sets[i]), len(sets[j])))
                if small / large < similarity:
                    return False
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return both / (small + large - both) >= similarity

            found = bucket_links(fps, tile_numbers(rows, "component"), radius, alike, label, guest)
            if found:
                a, b = np.array(found).T
                yield to_batch(LINK, a=node[a], b=node[b])

    def find(rows: DataFrame) -> DataFrame:
        chosen = checkpoint(rows)
        # a guest has as many tiles as its group has parts, so the tiles are joined by a shuffle, whatever the number of rows
        keys = chosen.select("node", "digest")
        if keys.count() <= BROADCAST_ROWS:
            keys = F.broadcast(keys)
        texts = docs.select("doc_id", "text").join(keys, (F.col("doc_id") == F.col("node")) & (F.xxhash64("text") == F.col("digest")))
        sets = texts.select("node", "text").mapInArrow(draw, "node long, hashes binary")
        return tile_rows(chosen.drop("digest").join(sets, "node"), "component").mapInArrow(run, "a long, b long")

    return linked_in_parts(checkpoint(groups), "component", TILE, find)


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, lanes: int = 16, tables: int = 8) -> DataFrame:
    """``doc_id, component_id``: documents linked by a similarity of ``similarity`` or more of their sets of word shingles.

    Candidates are read off wide fingerprints (64 bits for each of ``lanes``), within a
    radius six standard deviations beyond the similarity's; each link is then confirmed
    by the exact Jaccard similarity of the sets of shingle hashes (64 bits). Candidates
    meet in a bucket if their least two hashes agree in one of ``tables`` tables, which at
    0.8 fails once in 3000 pairs. Buckets are compared bit-sliced; those above BUCKET rows
    in parts (``linked_in_parts``).
    Texts without a word are one group; null ids take no part and have no row.
    """

    def draw(batches):
        for part in slices(batches):
            rows = [sketch(t.lower().split(), shingle, lanes, tables) for t in encoded(part.column("text"))]
            yield to_batch(SKETCH, doc_id=part.column("doc_id"), fp=[r[0] for r in rows], keys=[r[1] for r in rows], digest=part.column("digest"))

    named = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("digest"))
    sketches = checkpoint(named.mapInArrow(draw, "doc_id long, fp binary, keys array<long>, digest long"))
    nodes = sketches.groupBy("fp").agg(F.min(F.struct("doc_id", "digest")).alias("n"), F.first("keys").alias("keys"))
    nodes = nodes.select("fp", F.col("n.doc_id").alias("node"), F.col("n.digest").alias("digest"), "keys")
    rows = checkpoint(nodes.select(F.explode("keys").alias("key"), "node", "fp"))
    radius = candidate_radius(similarity, 64 * lanes)

    def run(batches):
        for rows in whole_tiles(batches, "key", lambda held: held.num_rows >= 8 * BUCKET):
            group = tile_numbers(rows, "key")
            many = np.bincount(group)[group] > 1
            if many.any():
                node, label, guest = (rows.column(c).to_numpy()[many] for c in ("node", "label", "guest"))
                fps = np.frombuffer(b"".join(rows.column("fp").filter(pa.array(many)).to_pylist()), np.uint64).reshape(-1, lanes)
                found = bucket_links(fps, group[many], radius, None, label, guest)
                if found:
                    a, b = np.array(found).T
                    yield to_batch(LINK, a=node[a], b=node[b])

    links = linked_in_parts(rows, "key", BUCKET, lambda r: tile_rows(r, "key").mapInArrow(run, "a long, b long"))
    near = checkpoint(components(links))
    # the least node of a component has no row of its own there
    near = near.union(near.select(F.col("component").alias("node"), "component").distinct())
    links = similar_sets(docs, nodes.drop("keys").join(near, "node"), shingle, similarity, radius)
    named = nodes.select("fp", "node").join(components(links), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return sketches.select("doc_id", "fp").join(named, "fp").select("doc_id", "component_id")


def first_of_each_group(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, without those that have a near copy of smaller doc_id.

    Rows without an id stay, each of them; rows that repeat an id and a text are one, the rest of their columns from any.
    """
    copies = similar_documents(docs, shingle, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    left = docs.join(copies, docs["doc_id"] == copies["_id"], "left_anti")
    return left.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(left.where("doc_id is null"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), 3, 2)
