"""Canonical exact fingerprints, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from embspark.llm.common import checkpoint, documents

#: Rows of copied groups, or of groups, that are broadcast at most (about 60 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: About so many neighbouring rows are ordered in one range, so long as MOST_RANGES are enough; bounds are looked up in two steps of STEP.
GROUP_ROWS, MOST_RANGES, STEP = 2048, 4096, 64


def canonical(text: Column) -> Column:
    """Compatibility composition and case folding by the ICU library that Spark ships, then white space made single."""
    odd = text.rlike(r"[^\x00-\x7F]")

    def icu(x: Column) -> Column:
        composed = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
        return composed(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(x), F.lit(True)))

    folded = F.when(odd, icu(text)).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash: two passes, the second seeded by another value first."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), canon)), 16, "0")))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")


def exact_groups(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """``fp, wide, group_id`` of the canonical texts that more than one row has: the smallest id with the same canonical bytes.

    ``prints(doc_id, th, fp)`` of all rows come first: inside each bucket of two or more
    the canonical bytes themselves are grouped, so a collision of hashes links nothing.
    ``wide`` is a second, independent digest that names a group's bytes in joins.
    """
    shared = checkpoint(prints.groupBy("fp").count().where("count > 1").select("fp"))
    if shared.count() <= BROADCAST_IDS:
        shared = F.broadcast(shared)
    ids = checkpoint(prints.join(shared, "fp", "left_semi").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select("doc_id", "text", _text_hash())
    copies = rows.join(ids, rows["doc_id"].eqNullSafe(ids["_id"]) & (F.col("th") == F.col("_th")), "left_semi")
    copies = copies.select("doc_id", canonical(F.coalesce("text", F.lit(""))).alias("canon"))
    groups = copies.groupBy(digest(F.col("canon")).alias("fp"), "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return groups.select("fp", F.sha2("canon", 256).alias("wide"), "group_id")


def id_ranges(keys: DataFrame) -> Column:
    """The range that a row of ``keys(doc_id, th)`` falls into, from numbers of rows: later in descending order of ids is lower, and below zero are rows without an id."""
    n, none = keys.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts, spare = (max(1, min(MOST_RANGES, k // GROUP_ROWS)) for k in (n - none, none))
    shares = [k / parts for k in range(1, parts)]
    bounds = sorted(set(keys.agg(F.percentile_approx("doc_id", shares, max(10_000, 8 * parts))).first()[0] or [])) if shares else []
    at_most = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    if bounds:
        every = F.array(*map(F.lit, bounds))
        coarse = at_most(F.array(*map(F.lit, bounds[STEP - 1 :: STEP]))) if len(bounds) >= STEP else F.lit(0)
        known = coarse * STEP + at_most(F.slice(every, coarse * STEP + 1, F.lit(STEP)))
    else:
        known = F.lit(0)
    share = F.col("th").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    loose = -1 - F.least(F.floor(share * spare), F.lit(spare - 1))
    return F.when(F.col("doc_id").isNull(), loose).otherwise(known).cast("long")


def ordered_ranges(docs: DataFrame) -> DataFrame:
    """``doc_id, text, th, bucket, guest``: all rows by ranges of ids; each range also has the first row of the next one, as a guest after its own.

    Ranges come from the distribution of the ids, so outliers and gaps cost nothing; the
    heads of the ranges (2 * MOST_RANGES at most) go through the driver.
    """
    keys = checkpoint(docs.select("doc_id", _text_hash()))
    bucket = id_ranges(keys).alias("bucket")
    first = keys.select("doc_id", "th", bucket).groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("down"), "th")).alias("head"))
    heads = sorted(((r["bucket"], r["head"]["down"], r["head"]["th"]) for r in first.collect()), key=lambda r: -r[0])
    guests = [(None if down is None else ~down, th, heads[k - 1][0]) for k, (_, down, th) in enumerate(heads)]
    table = F.broadcast(docs.sparkSession.createDataFrame(guests, "_id long, _th long, host long"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _text_hash()).withColumn("bucket", bucket)
    rows = rows.join(table, rows["doc_id"].eqNullSafe(table["_id"]) & (F.col("th") == F.col("_th")), "left")
    own, other = F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    places = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, other))
    return rows.select("doc_id", "text", "th", F.explode(places).alias("at")).select("doc_id", "text", "th", "at.bucket", "at.guest")


def _order() -> WindowSpec:
    """Descending ids; rows of one id, and rows without one, by a hash of their texts."""
    return Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "th")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: each row and the next in descending id (the first follows the last)."""
    rows = ordered_ranges(docs).withColumn("next_text", F.lead("text").over(_order()))
    return rows.where("guest = 0").select("doc_id", "text", "next_text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all rows of ``docs(doc_id, text, ...)``, of their edited texts, and how alike they are.

    The edited text has its last half (code points, rounded down) replaced by the start
    of the next document's text, in descending id. An exact fingerprint is alike to
    another by 1.0 if digest and canonical bytes are equal, else 0.0. ``group_id`` is the
    smallest id with the same canonical text (the row's own if there is no other).
    Null text: empty. Null ids come after all others; rows that tie are ordered by a hash
    of their texts. Ids may lie anywhere in the range of longs. An empty table gives no rows.
    Each text is moved once and made canonical once, and so is its edited form.
    """
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = ordered_ranges(docs).withColumn("next_text", F.lead("text").over(_order()))
    rows = rows.select("doc_id", "th", "bucket", "guest", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("canon", canonical(F.col("text"))).drop("text").withColumn("ecanon", canonical(F.col("edited")))
    rows = rows.withColumn("next_canon", F.lead("canon").over(_order())).where("guest = 0")
    rows = rows.withColumn("fp", digest(F.col("canon"))).withColumn("efp", digest(F.col("ecanon")))

    def alike(fp: str, text: str) -> Column:
        return F.when(F.col("fp") == F.col(fp), F.col("canon") == F.col(text)).otherwise(False).cast("double")

    out = checkpoint(rows.withColumn("nfp", digest(F.col("next_canon"))).select(
        "doc_id", "th", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "efp", F.sha2("canon", 256).alias("wide"),
        alike("efp", "ecanon").alias("near_edited"), alike("nfp", "next_canon").alias("near_next"),
    ))
    groups = checkpoint(exact_groups(docs, out.select("doc_id", "th", "fp")))
    if groups.count() <= BROADCAST_IDS:
        groups = F.broadcast(groups)
    return out.join(groups, ["fp", "wide"], "left").select(
        "doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"), "near_edited", "near_next",
        F.coalesce("group_id", "doc_id").alias("group_id"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
