import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from embspark.llm.sentencepieces import PieceCoder, piece_codes
from tests.llm.common import fixture_rows, sample, table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(library):
    coder, rng = PieceCoder(PATH), random.Random(4)
    texts = [t or "" for _, t in sample(120)] + ["  Hello   wörld\n\n x ", " ", "▁ a▁b", "日本語 \U0001f600 é ́", "\t\x00", "a" * 300, "http://x.y/z?q=1&&&&", "    deep    indent"]
    texts += ["".join(rng.choices("abcdefghij  .,tionreshéüß漢😀", k=rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        ids = coder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t), t
        assert coder.decode(ids) == library.decode(library.encode(t)), t


def test_documents(spark, library):
    for df, rows in (fixture_rows(spark), (table(spark, sample()), sample())):
        got = {r["doc_id"]: tuple(r)[1:] for r in piece_codes(df, PATH).collect()}
        for i, t in rows:
            t = t or ""
            ids = library.encode(t)
            want = (len(t.encode()), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(library.decode(ids).encode()).hexdigest(), library.decode(ids) == t)
            assert got[i] == want
    assert piece_codes(table(spark, []), PATH).count() == 0
    assert piece_codes(table(spark, [(None, "a"), (None, "a")]), PATH).count() == 2


def test_best_scores_by_brute_force():
    coder = PieceCoder(PATH, "unigram")
    rng = random.Random(2)
    coder.score = {p: -rng.random() * 10 for p in coder.score}

    def best(word):
        if not word:
            return 0.0
        return max(coder.score[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in coder.score)

    for word in ("▁hello", "▁there", "tion", "▁a"):
        got = coder.pieces(word)
        assert "".join(got) == word and abs(sum(coder.score[p] for p in got) - best(word)) < 1e-9


def test_long_words_and_small_memos_change_nothing(library, monkeypatch):
    import embspark.llm.sentencepieces as m

    monkeypatch.setattr(m, "MEMO_BYTES", 5000)
    monkeypatch.setattr(m, "PAIR_ENTRIES", 20)
    coder, rng = PieceCoder(PATH), random.Random(8)
    texts = ["".join(rng.choices("abcdefghij,.漢字日本語", k=3000)), "ab" * 4000, *(t or "" for _, t in sample(20))]
    for t in texts:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == library.encode(t)
        assert max(coder.held.values()) <= 5000 and all(len(w) <= m.REMEMBERED for w in coder.memo)


def test_best_paths_of_documents(spark, library):
    coder = PieceCoder(PATH, "unigram")

    def best(word):
        # every split, by sums of the prefixes before it
        top = [0.0] + [None] * len(word)
        for end in range(1, len(word) + 1):
            sums = [top[at] + coder.score[word[at:end]] for at in range(end) if top[at] is not None and word[at:end] in coder.score]
            if word[end - 1] not in coder.score and top[end - 1] is not None:
                sums.append(top[end - 1] + coder.least)
            top[end] = max(sums) if sums else None
        return top[-1]

    rows = [(i, t[:400] if t else t) for i, t in sample(12)]
    for r in piece_codes(table(spark, rows), PATH, best=True).collect():
        text = dict(rows)[r["doc_id"]] or ""
        ids = coder.encode(text)
        assert coder.decode(ids) == text or not text.isprintable()
        want = best("▁" + text.replace(" ", "▁")) if text else 0.0
        assert abs(r["best_score"] - want) < 1e-6 * max(1, abs(want))
        assert (r["n_best_pieces"], r["best_crc32"]) == (len(ids) // 4, zlib.crc32(ids))
