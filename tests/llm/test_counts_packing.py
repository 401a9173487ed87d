import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from embspark.llm.packing import best_fit, pack, pack_histogram
from embspark.llm.token_counts import segments, token_counts
from tests.llm.common import fixture_rows, sample, table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("source", ["sample", "fixture"])
def test_token_counts_equal_the_library(spark, library, source):
    df, rows = fixture_rows(spark) if source == "fixture" else (table(spark, sample()), sample())
    got = {r["doc_id"]: r for r in token_counts(df, PATH, 100).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        n = len(library(text))
        assert tuple(got[i])[1:] == (len((text or "").encode()), n, n > 100)


def test_segments_cut_at_white_space_only():
    text = b"aa bb\ncc " * 50 + b"d" * 40
    parts = list(segments(text, 16))
    assert b"".join(parts) == text and len(parts) > 20
    assert [w for p in parts for w in p.split()] == text.split()


def test_empty_and_null_ids(spark):
    assert token_counts(table(spark, []), PATH).count() == 0
    assert pack(table(spark, []), PATH).count() == 0
    assert [tuple(r) for r in token_counts(table(spark, [(None, "a b")]), PATH).collect()] == [(None, 3, 2, False)]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_cover_documents_and_fill_sequences(spark, library, capacity):
    rows = [*sample(), (None, "no id here"), (9999, "twice"), (9999, "twice")]
    got = pack(table(spark, rows), PATH, capacity).collect()
    want = []
    for i, text in rows:
        ids = [*library(text), 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want.append((i, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r[:5])
    assert sorted(map(key, got)) == sorted(map(key, want))
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(held) <= total / capacity * 1.05 + 2


def test_plans_use_the_histogram_up():
    rng = np.random.default_rng(1)
    for _ in range(20):
        held = np.zeros(129, np.int64)
        np.add.at(held, rng.integers(1, 129, rng.integers(0, 400)), rng.integers(1, 5))
        for plan in (pack_histogram(held), best_fit(held)):
            used = np.zeros(129, np.int64)
            for pattern, n in plan:
                assert n > 0 and sum(x * m for x, m in pattern) <= 128
                for x, m in pattern:
                    used[x] += n * m
            assert (used == held).all()


def test_long_runs_without_white_space_equal_the_library_in_bounded_memory(library, monkeypatch):
    import random

    import embspark.llm.subwords as m

    rng = random.Random(6)
    texts = ["".join(rng.choices("日本語漢字かなのですカタ、。", k=9000)), "".join(rng.choices("abcdefghijklmnop0123456789+/'=", k=20000)), "été" * 7000, "e\u0301" * 9000, "x<|endoftext|>y" * 2000]
    monkeypatch.setattr(m, "LONG", 500)
    monkeypatch.setattr(m, "MEMO_BYTES", 20000)
    coder = m.WordEncoder(PATH)
    for t in [*texts, *(x or "" for _, x in sample(20))]:
        assert np.frombuffer(coder.encode([t.encode()])[0], "<u4").tolist() == library(t)
        assert coder.memo.held <= 20000 and all(len(c) <= m.REMEMBERED for c in coder.memo)


def test_counts_with_small_memos_and_batches(spark, library, monkeypatch):
    import embspark.llm.subwords as limits
    import embspark.llm.token_counts as m

    monkeypatch.setattr(limits, "MEMO_BYTES", 3000)
    monkeypatch.setattr(limits, "LONG", 400)
    monkeypatch.setattr(m, "BATCH", 7)
    counter = m.BatchCounter(PATH)
    texts = [(t or "") for _, t in sample(20)] + ["漢字" * 900, "q" * 70 + " " + "1x" * 300]
    for at in range(0, len(texts), 5):
        assert counter.lengths([t.encode() for t in texts[at : at + 5]]) == [len(library(t)) for t in texts[at : at + 5]]
