"""Small document tables with every awkward case, shared by the tests of the text operators."""

from __future__ import annotations

import random

from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, bucket long, length long, shard int, salt int"


def sample(n: int = 60, seed: int = 3) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delta.", "été", "naïve", "x", "#tag", "$5", "don't", "日本", "ünder", "…", "ok!"]
    words += ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=90))
    texts: list[str | None] = []
    for _ in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), passage)
        texts.append("\n".join(lines))
    texts += [None, "", " \n\t ", "one", "one two", texts[0], texts[0], texts[3] + " tail", "same word " * 90, "a" * 900, "<|endoftext|> A <|ENDOFTEXT|>"]
    texts.append(" ".join(rng.choices(words, k=9000)))
    texts.append(texts[-1][: len(texts[-1]) // 2] + " changed " + texts[-1][len(texts[-1]) // 2 :])
    ids = rng.sample(range(0, 500), len(texts))
    return list(zip(ids, texts, strict=True))


def table(spark, rows):
    """``rows`` as a documents table with further columns whose names clash with the operators' own."""
    full = [(i, t, "xx", f"src{(i or 0) % 3}", len(t or ""), "z", 1, 2, 3, 4) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def fixture_rows(spark, sf: str = "sf0.001"):
    df = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.collect()]


def words(text):
    return (text or "").encode().split()
