"""Quality rules with cross-document line frequency."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embspark.llm.common import checkpoint, documents, encoded, slices, to_batch

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), *((n, pa.int64()) for n in COUNTS)])
#: Lines over the limit that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 500_000


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    packed = text.translate(None, SPACE)
    # every code point has one byte that is not a continuation byte
    chars = len(packed) if packed.isascii() else len(packed.decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    repeats = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeats += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def with_digest(docs: DataFrame) -> DataFrame:
    """``docs`` with ``digest``: rows of one id (or of none) are told apart by it, and by it alone are they the same row."""
    return docs.withColumn("digest", F.xxhash64("text", "source"))


def base_stats(docs: DataFrame) -> DataFrame:
    def run(batches):
        for part in slices(batches):
            rows = [text_stats(t) for t in encoded(part.column("text"))]
            yield to_batch(STATS, doc_id=part.column("doc_id"), digest=part.column("digest"), **{n: [r[k] for r in rows] for k, n in enumerate(COUNTS)})

    return docs.select("doc_id", "digest", "text").mapInArrow(run, ", ".join(f"{n} long" for n in STATS.names))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _line_key(normal: Column, host: Column) -> Column:
    return F.xxhash64(host, normal)


def document_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, document, pos, key, words``: each line with a word; ``document`` is the id, or stands for the text of a row without one."""
    lines = docs.select(
        "doc_id", "digest", F.coalesce("doc_id", F.xxhash64("text")).alias("document"), F.coalesce("source", F.lit("")).alias("host"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).withColumn("normal", _normal(F.col("line")))
    words = F.size(F.split("normal", " ")).alias("words")
    return lines.where("normal <> ''").select("doc_id", "digest", "document", "pos", _line_key(F.col("normal"), F.col("host")).alias("key"), words)


def common_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """``key`` of the lines found in more than ``max_docs`` different documents of one host."""
    return lines.groupBy("key").agg(F.countDistinct("document").alias("n")).where(F.col("n") > max_docs).select("key")


def removed_lines(docs: DataFrame, max_docs: int = 20) -> DataFrame:
    """``doc_id, digest, n_removed_words, removed_keys``: for documents that hold lines above the limit."""
    lines = document_lines(docs)
    common = checkpoint(common_lines(lines, max_docs))
    if common.count() <= BROADCAST_LINES:
        common = F.broadcast(common)
    # a row that is there twice has each of its lines once
    gone = lines.join(common, "key").groupBy("doc_id", "digest").agg(F.collect_set(F.struct("pos", "key", "words")).alias("gone"))
    n = F.aggregate("gone", F.lit(0).cast("long"), lambda so_far, x: so_far + x["words"])
    return gone.select("doc_id", "digest", n.alias("n_removed_words"), F.array_distinct(F.transform("gone", lambda x: x["key"])).alias("removed_keys"))


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["digest"] == right["digest"])


def _verdicts(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_docs: int = 20, max_removed_percent: int = 50) -> DataFrame:
    """``doc_id, digest``, counts, ``n_removed_words, removed_keys, base_failed, kept`` for each row of ``docs`` (with ``digest``)."""
    stats, removed = base_stats(docs), removed_lines(docs, max_docs)
    out = stats.join(removed, _same_row(stats, removed), "left").select(stats["*"], "n_removed_words", "removed_keys")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = 100 * F.col("n_removed_words") > max_removed_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~(failed | depleted))


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, source, ...)``: counts, ``base_failed``, ``kept``, ``removed_keys``.

    Base rules: fewer than ``min_words`` (50) words, or more than ``max_repeat_percent`` (50) %
    of the words in repeated three-word windows. Line rule: lines are trimmed,
    lower-cased, white space made single, hashed with their host (``source``), and the
    different documents of each are counted over all documents; lines above
    ``max_docs`` (20) go, whatever stands next to them, and a document that loses over
    ``max_removed_percent`` (50) % of its words is rejected.

    Null or empty text: no words, so base_failed. Null source: one host of its own.
    Null doc_id: a document of its own text. Rows that repeat an id are judged each by
    their own text, and count as one document of a line. Other columns are ignored.
    """
    return _verdicts(with_digest(docs.select("doc_id", "text", "source")), **limits).drop("digest")


def clean_texts(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all its columns and without the lines above the limit; each row goes by its own text."""
    own = with_digest(docs.select("doc_id", "text", "source"))
    verdict = _verdicts(own, **limits).where("kept").select("doc_id", "digest", "removed_keys").dropDuplicates(["doc_id", "digest"])
    # the columns of docs may have any names
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text", "source").alias("digest"))
    host = F.coalesce("row.source", F.lit(""))
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains("removed_keys", _line_key(_normal(x), host))), "\n")
    text = F.when(F.col("removed_keys").isNull(), F.col("row.text")).otherwise(left)
    kept = rows.join(verdict, _same_row(rows, verdict)).select("row", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return kept.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("removed_keys")
