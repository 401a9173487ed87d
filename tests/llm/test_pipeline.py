import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_quality import brute_verdicts
from tests.llm.test_repeats import brute as brute_windows
from tests.llm.test_simhash import brute_components, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    body = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    notice = "Common notice of this host with a few words"
    passage = body(60)
    rows = [(2 * i, f"{body(rng.randint(60, 120))}\n{notice if i % 2 else body(9)}\n{passage if i % 5 == 0 else body(20)}", "a") for i in range(60)]
    for i in range(12):  # near copies
        words = rows[3 * i][1].split(" ")
        words[rng.randrange(len(words))] = "edited"
        rows.append((2 * i + 1, " ".join(words), "b"))
    rows += [(300 + i, rows[7][1], "c") for i in range(4)]  # exact copies
    rows += [(400, "too short", "a"), (401, None, "a"), (402, "", None), (None, body(70), "a"), (None, body(70), None), (403, "same words again " * 60, "a")]
    return [(i, t, "xx", h, len(t or "")) for i, t, h in rows]


def as_rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()]


def check_quality(before, after):
    want = brute_verdicts([(i, t, h) for i, t, _, h, _ in before])
    left = Counter((r[0], len(r[1].split())) for r in after)
    assert left == Counter((r[0], len(r[1].split()) - gone) for r, (gone, kept) in zip(before, want, strict=True) if kept)
    assert all("Common notice" not in t for _, t, _, h, _ in after if h == "a")


def check_near_duplicates(before, after):
    sets = {i: shingles(t) for i, t, *_ in before if i is not None}
    want = brute_components(sets, lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    assert sorted(r for r in after if r[0] is not None) == sorted(r for r in before if want.get(r[0]) == r[0] and r[0] is not None)
    assert sum(r[0] is None for r in after) == sum(r[0] is None for r in before)


def check_passages(before, after):
    raw = {i: t.encode() for i, t, *_ in before if i is not None}
    gone = brute_windows(raw, corpus_pipeline.PASSAGE_BYTES, True)
    want = {i: bytes(x for k, x in enumerate(t) if k not in gone[i]).decode() for i, t in raw.items()}
    assert {i: t for i, t, *_ in after if i is not None} == {i: t for i, t in want.items() if t.split()}
    assert any(gone.values()) and all(n == len(t) for _, t, _, _, n in after)


def check_packing(before, after):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, *_ in before:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want.update((i, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    assert Counter(tuple(r)[:5] for r in after) == want
    total = sum(r["length"] for r in after)
    # some hundred pieces need not fit the least number of sequences exactly
    assert 0 <= len({r["sequence_id"] for r in after}) - -(-total // 4096) <= 1


def test_every_stage_and_the_whole(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    checks = [check_quality, check_near_duplicates, check_passages]
    for (name, stage), check in zip(corpus_pipeline.STAGES, checks, strict=False):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        check(as_rows(docs), as_rows(after))
        docs = after
    name, stage = corpus_pipeline.STAGES[3]
    packed = stage(spark, docs, str(tmp_path)).collect()
    check_packing(as_rows(docs), packed)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in whole) == Counter(tuple(r)[:5] for r in packed)


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
