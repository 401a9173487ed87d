import hashlib
import random

import numpy as np
import pytest

import embspark.llm.byte_repeats as b
import embspark.llm.repeats as r
import embspark.llm.word_repeats as w
from embspark.llm.grouping import common_prefixes, suffix_array
from embspark.llm.suffix_trees import Tree
from tests.llm.common import fixture_rows, sample, table, words


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_suffix_arrays_of_random_texts(letters):
    rng = random.Random(letters)
    for _ in range(300):
        text = [rng.randrange(letters) - 1 for _ in range(rng.randint(0, 60))]
        want = sorted(range(len(text)), key=lambda i: text[i:])
        got = suffix_array(np.array(text, np.int64))
        assert got.tolist() == want
        shared = common_prefixes(np.array(text, np.int64), got)
        for x, y, n in zip(want, want[1:], shared[1:].tolist(), strict=False):
            assert text[x : x + n] == text[y : y + n] and text[x + n : x + n + 1] != text[y + n : y + n + 1]


def brute(seqs, length, keep_first):
    """doc -> covered positions; seqs: doc -> sequence."""
    where = {}
    for d in sorted(seqs):
        s = seqs[d]
        for i in range(len(s) - length + 1):
            where.setdefault(tuple(s[i : i + length]) if not isinstance(s, bytes) else s[i : i + length], []).append((d, i))
    out = {d: set() for d in seqs}
    for at in where.values():
        for d, i in at[1:] if keep_first else at if len(at) > 1 else ():
            out[d].update(range(i, i + length))
    return out


def runs(xs):
    return sum(x - 1 not in xs for x in xs)


@pytest.fixture(params=["normal", "hot", "small"])
def mode(request, monkeypatch):
    if request.param == "hot":
        monkeypatch.setattr(r, "HOT", 2)
    if request.param == "small":
        monkeypatch.setattr(r, "CHUNK", 5)
        monkeypatch.setattr(r, "STEP", 1000)
    return request.param


@pytest.mark.parametrize("length", [20, 5])
def test_word_windows(spark, mode, length):
    rows = sample()
    cover = brute({i: words(t) for i, t in rows}, length, True)
    got = {x["doc_id"]: tuple(x)[1:] for x in w.remove_repeats(table(spark, rows), length).collect()}
    for i, t in rows:
        left = [x for k, x in enumerate(words(t)) if k not in cover[i]]
        assert got[i] == (len(words(t)), len(cover[i]), hashlib.sha256(b" ".join(left)).hexdigest())


@pytest.mark.parametrize("keep_first", [False, True])
def test_byte_windows(spark, mode, keep_first):
    rows = sample(25)
    rows = [(i, t[:9000] if t else t) for i, t in rows]
    raw = {i: (t or "").encode() for i, t in rows}
    cover = brute(raw, 60, keep_first)
    got = {x["doc_id"]: tuple(x)[1:] for x in b.remove_repeats(table(spark, rows), 60, keep_first).collect()}
    for i, t in raw.items():
        left = bytes(x for k, x in enumerate(t) if k not in cover[i])
        assert got[i] == (len(t), len(cover[i]), runs(cover[i]), hashlib.sha256(left).hexdigest())


def test_fixture_tables(spark):
    df, rows = fixture_rows(spark)
    cover = brute({i: words(t) for i, t in rows}, 20, True)
    got = {x["doc_id"]: x["n_removed"] for x in w.remove_repeats(df).collect()}
    assert got == {i: len(c) for i, c in cover.items()}
    cover = brute({i: t.encode() for i, t in rows}, 400, False)
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in b.remove_repeats(df).collect()}
    assert got == {i: (len(c), runs(c)) for i, c in cover.items()}


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None), (3, "")]
    got = sorted((x["doc_id"] or 0, x["n_removed"]) for x in w.remove_repeats(table(spark, rows)).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (3, 0)]
    got = sorted((x["doc_id"] or 0, x["n_removed"]) for x in b.remove_repeats(table(spark, rows)).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (3, 0)]
    assert w.remove_repeats(table(spark, [])).count() == 0 and b.remove_repeats(table(spark, [])).count() == 0


def test_texts_without_later_copies(spark):
    text = " ".join(f"wört{i}" for i in range(200))
    df = table(spark, [(1, "head " + text), (2, "other " + text + " tail"), (3, text), (4, "short é")])
    out = b.deduplicated_texts(df, 200)
    assert out.columns == df.columns
    got = {x["doc_id"]: x for x in out.collect()}
    assert got[1]["text"] == "head " + text and got[4]["text"] == "short é" and 3 not in got
    assert got[2]["text"] in ("other tail", "other  tail", "other tail ", "othertail") and got[2]["n_chars"] == len(got[2]["text"])


@pytest.fixture(params=[(20_000, 1 << 25), (2, 1 << 25), (20_000, 2000), (2, 2000)])
def limits(request, monkeypatch):
    monkeypatch.setattr(r, "HOT", request.param[0])
    monkeypatch.setattr(r, "HELD_BYTES", request.param[1])
    monkeypatch.setattr(r, "HELD_WINDOWS", request.param[1] // 40)
    monkeypatch.setattr(r, "TEXT_BYTES", 3000)


def test_copies_in_many_documents_and_shorter_passages(spark, limits):
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(60)}" for _ in range(50))
    rows = [(3 * i + 1, " ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randint(0, 40))) + " " + passage[rng.randint(0, 60) :] + f" t{i}") for i in range(150)]
    rows += [(3 * i, passage + " " + passage) for i in range(40)] + [(601, None), (602, ""), (None, passage)]
    raw = {i: (t or "").encode() for i, t in rows if i is not None}
    long, short = brute(raw, 90, False), brute(raw, 45, True)
    got = {x["doc_id"]: x for x in b.remove_repeats(table(spark, rows), 90, passage=45).collect()}
    assert {i: (got[i]["n_removed"], got[i]["n_spans"], got[i]["n_repeated"]) for i in raw} == {i: (len(long[i]), runs(long[i]), len(short[i])) for i in raw}
    assert got[None]["n_removed"] == got[None]["n_repeated"] == 0
    seqs = {i: words(t) for i, t in rows if i is not None}
    cover = brute(seqs, 12, True)
    got = {x["doc_id"]: x["n_removed"] for x in w.remove_repeats(table(spark, rows), 12).collect()}
    assert {i: got[i] for i in seqs} == {i: len(c) for i, c in cover.items()}


def test_columns_with_names_of_the_operators_own(spark):
    text = " ".join(f"w{i}" for i in range(100))
    names = ["spans", "again", "anchor", "hot", "level", "start"]
    df = spark.createDataFrame([(1, text, 3, *names), (2, text, 3, *names), (None, None, 0, *names)], "doc_id long, text string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    out = b.deduplicated_texts(df, 60)
    assert out.columns == df.columns and {(r["doc_id"], r["spans"], r["hot"]) for r in out.collect()} == {(1, "spans", "hot"), (None, "spans", "hot")}


@pytest.mark.parametrize("letters", [2, 3, 8])
def test_deep_nodes_of_a_tree_are_the_maximal_repeats(letters):
    rng = random.Random(letters)
    for _ in range(30):
        text = [rng.randrange(1, letters + 1) for _ in range(rng.randint(2, 60))]
        n = len(text)
        suffixes = np.zeros((n, n + 1), np.uint32)
        for i in range(n):
            suffixes[i, : n - i] = text[i:]
            suffixes[i, n - i] = letters + 1 + i  # an end of its own
        where = {}
        for i in range(n):
            for j in range(i + 1, n + 1):
                where.setdefault(tuple(text[i:j]), []).append(i)
        for depth in (1, 3):
            # a repeat that cannot be lengthened to either side in all of its places
            before = lambda i: text[i - 1] if i else -i - 1
            after = lambda i, k: text[i + k] if i + k < n else -i - 1
            right = {s: at for s, at in where.items() if len(s) >= depth and len(at) > 1 and len({after(i, len(s)) for i in at}) > 1}
            tree = Tree(suffixes)
            nodes = {tuple(text[at[0] : at[0] + d]): sorted(at.tolist()) for d, at in tree.nodes(depth)}
            assert nodes == right
            maximal = {s for s, at in nodes.items() if len({before(i) for i in at}) > 1}
            assert maximal == {s for s, at in right.items() if len({before(i) for i in at}) > 1}
            classes = tree.at_depth(depth)
            for i in range(n):
                for j in range(i):
                    same = i + depth <= n and text[i : i + depth] == text[j : j + depth]
                    assert (classes[i] == classes[j]) == same or j + depth > n or i + depth > n
    groups = np.array([0, 1, 0, 1])
    same = Tree(np.ones((4, 3), np.uint32), groups).at_depth(3)
    assert same[0] == same[2] != same[1] == same[3]
