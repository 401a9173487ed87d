import random
import re
from collections import Counter

import pytest

from embspark.llm.quality import clean_texts, quality_rules
from tests.llm.common import fixture_rows, sample, table


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    n_chars, seen, dup = sum(map(len, words)), set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), n_chars, sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


@pytest.mark.parametrize("source", ["sample", "fixture"])
def test_base_statistics(spark, source):
    df, rows = fixture_rows(spark) if source == "fixture" else (table(spark, sample()), sample())
    got = {r["doc_id"]: r for r in quality_rules(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text)
        assert not (r["base_failed"] and r["kept"])


def boilerplate():
    body = lambda i, k: " ".join(f"w{i}x{j}" for j in range(k))
    notice = "  Shared   NOTICE " + " ".join(f"r{k}" for k in range(60))
    rows = [(3 * i, f"{body(i, 60)}\n{notice.lower() if i % 2 else notice}\n{body(900 + i, 5)}") for i in range(30)]
    rows += [(3 * i, f"{body(i, 15)}\n{notice}\n{body(i + 500, 12)}") for i in range(30, 40)]  # mostly the notice
    rows += [(1 + 3 * i, f"{body(7, 40)}\n{body(8, 40)}\nedit {i}") for i in range(30)]  # near copies, in one host
    return rows + [(None, body(77, 60)), (2, None), (5, "")]


def test_common_lines_go_and_depleted_documents_are_rejected(spark):
    rows = boilerplate()
    got = {r["doc_id"]: r for r in quality_rules(table(spark, rows)).collect()}
    for i in range(30):
        assert got[3 * i]["kept"] == (2 * 62 < 2 * 65) and got[3 * i]["n_removed_words"] == 62
        assert got[1 + 3 * i]["kept"] and got[1 + 3 * i]["n_removed_words"] == 0
    for i in range(30, 40):
        assert not got[3 * i]["kept"] and not got[3 * i]["base_failed"]
    assert got[None]["kept"] and not got[2]["kept"] and not got[5]["kept"]


def test_cleaned_documents_keep_their_columns(spark):
    df = table(spark, boilerplate())
    out = clean_texts(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert "NOTICE" not in got[0]["text"] and got[0]["text"].count("\n") == 1 and got[0]["n_chars"] == len(got[0]["text"])
    assert 90 not in got and None in got and 2 not in got


@pytest.mark.parametrize("n_lines", [1, 2, 3])
@pytest.mark.parametrize("at_end", [True, False])
def test_blocks_of_common_lines_go_by_their_count_alone(spark, n_lines, at_end):
    block = [f"Notice {k} of all pages here" for k in range(n_lines)]

    def text(i, size):
        body = [" ".join(f"w{i}x{j}" for j in range(size))]
        return "\n\n".join(body + block if at_end else block + body)

    rows = [(3 * i, text(i, 60)) for i in range(21)] + [(3 * i + 1, text(i, 60)) for i in range(100, 120)]
    rows += [(3 * i + 2, text(200, 60)) for i in range(21)]  # exact copies are documents too
    rows += [(3 * i + 2, text(i, 60)) for i in range(300, 301)] + [(0, text(0, 60))]
    got = {r["doc_id"]: r["n_removed_words"] for r in quality_rules(table(spark, rows[:-1])).collect()}
    for i in got:
        assert got[i] == {0: 6 * n_lines, 1: 0, 2: 60 + 6 * n_lines if i < 300 else 6 * n_lines}[i % 3]
    again = quality_rules(table(spark, [r for r in rows[:20] + rows[-1:]])).collect()  # an id that is repeated counts once
    assert len(again) == 21 and all(r["n_removed_words"] == 0 for r in again)
    cleaned = clean_texts(table(spark, rows)).collect()
    assert all(("Notice" in r["text"]) == (r["doc_id"] % 3 == 1) for r in cleaned)


def test_documents_made_mostly_of_a_block_are_rejected(spark):
    block = "\n".join(" ".join(f"b{k}y{j}" for j in range(40)) for k in range(2))
    rows = [(3 * i, " ".join(f"w{i}x{j}" for j in range(20)) + "\n" + block) for i in range(21)]
    got = quality_rules(table(spark, rows)).collect()
    assert all(r["n_removed_words"] == 80 and not r["kept"] and not r["base_failed"] for r in got)


def test_empty_table(spark):
    assert quality_rules(table(spark, [])).count() == 0


def brute_verdicts(rows, max_docs=20):
    """kept and removed words of (id, text, host) rows by the rules alone."""
    space = re.compile(r"[\x20\x09-\x0d]+")
    normal = lambda line: space.sub(" ", line).strip(" ").lower()
    seen = {}
    for i, text, host in rows:
        for line in (text or "").split("\n"):
            if normal(line):
                seen.setdefault((host or "", normal(line)), set()).add(("text", text) if i is None else i)
    out = []
    for _, text, host in rows:
        n_words, _, _, _, _, failed = brute(text)
        gone = sum(len(normal(line).split(" ")) for line in (text or "").split("\n") if normal(line) and len(seen[host or "", normal(line)]) > max_docs)
        out.append((gone, not failed and 100 * gone <= 50 * n_words))
    return out


def odd_rows():
    rng = random.Random(2)
    body = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    ends, starts = ["", "\r", " \t", "\x0b\x0c"], ["", "\t", "  ", "\x0c "]
    rows = []
    for k in range(260):
        host = rng.choice(["a", "b", None])
        lines = [body(rng.choice([10, 55, 80]))]
        for notice in range(4):
            if rng.random() < (0.5, 0.35, 0.2, 0.05)[notice]:
                text = " ".join(f"Notice{notice} Part{j}" for j in range(12 * notice + 4))
                if rng.random() < 0.5:
                    text = text.upper().replace(" ", " \t", 2)
                lines.insert(rng.randint(0, len(lines)), rng.choice(starts) + text + rng.choice(ends))
        rows.append((rng.choice([None, k, k, k % 40]), "\n".join(lines) if rng.random() < 0.9 else "\r\n\r\n".join(lines), host))
    rows += [rows[3], rows[4], (7, body(60), "a"), (7, "bad", "a"), (None, body(60), "a"), (None, "bad2", "a"), (None, None, "a"), (300, "", None)]
    return rows


def test_every_verdict_by_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, h, "x", 1) for i, t, h in rows], "doc_id long, text string, source string, digest string, row int").repartition(6)
    want = brute_verdicts(rows)
    assert len({w for w in want}) > 6
    got = Counter((r["doc_id"], r["n_words"], r["n_removed_words"], r["kept"]) for r in quality_rules(df).collect())
    assert got == Counter((i, brute(t)[0], n, kept) for (i, t, _), (n, kept) in zip(rows, want, strict=True))
    out = clean_texts(df)
    assert out.columns == df.columns
    left = Counter((r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in out.collect())
    assert left == Counter((i, h, brute(t)[0] - n) for (i, t, h), (n, kept) in zip(rows, want, strict=True) if kept)
