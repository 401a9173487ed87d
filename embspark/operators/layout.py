"""Slots, pages and dirty runs of the page model: 4 bytes a float, rows that never cross a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 4096


def rows_per_page(dim: Column, page: int = PAGE) -> Column:
    return F.floor(F.lit(page) / (dim * 4)).cast("long")


def running(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 65_536) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` up to and with each row, by ``keys`` in ascending ``order`` (longs, unique for the keys).

    The order is cut into ranges of ``width``: sums run inside them, and the ranges' own
    sums (one row each) are added up before. So a key is not one task's.
    """
    cut = rows.withColumn("_range", F.floor(F.col(order) / width).cast("long")).withColumn("_value", value.cast("long"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    own = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.withColumn("_own", F.sum("_value").over(own)).join(sums, [*keys, "_range"])
    return out.select(*rows.columns, (F.col("_own") + F.col("_before")).cast("long").alias(name))


def slots(puts: DataFrame) -> DataFrame:
    """``dim, feat_id, entry_idx, page``: ids of each dim in the order of their first put."""
    first = puts.groupBy("dim", "feat_id").agg(F.min("seq").cast("long").alias("seq"))
    ranked = running(first, ["dim"], "seq", F.lit(1), "nth").select("dim", "feat_id", (F.col("nth") - 1).alias("entry_idx"))
    return ranked.withColumn("page", F.floor(F.col("entry_idx") / rows_per_page(F.col("dim"))).cast("long"))


def layout(puts: DataFrame, page: int = PAGE) -> DataFrame:
    rows = puts.groupBy("dim").agg(F.countDistinct("feat_id").alias("n_entries"))
    per = rows_per_page(F.col("dim"), page)
    return rows.select("dim", (F.col("dim") * 4).alias("entry_size"), per.alias("rows_per_page"), "n_entries", F.ceil(F.col("n_entries") / per).alias("pages"))


def dirty_pages(log: DataFrame) -> DataFrame:
    """``generation, dim, page`` of the pages that puts touched."""
    at = slots(log).select("dim", "feat_id", "page")
    return log.join(at, ["dim", "feat_id"]).select("generation", "dim", "page").distinct()


def dirty_runs(pages: DataFrame) -> DataFrame:
    """Runs of consecutive pages: ``generation, dim, pg_start, pg_count``."""
    ranked = running(pages, ["generation", "dim"], "page", F.lit(1), "nth")
    runs = ranked.withColumn("island", F.col("page") - F.col("nth")).groupBy("generation", "dim", "island")
    return runs.agg(F.min("page").alias("pg_start"), F.count("*").alias("pg_count")).drop("island")


def with_gap(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``pages`` with ``nth`` by ``keys`` and ``gap``, how far the page before is (null for the first)."""
    ranked = running(pages, keys, "page", F.lit(1), "nth")
    last = ranked.select(*keys, (F.col("nth") + 1).alias("nth"), F.col("page").alias("_last"))
    return ranked.join(last, [*keys, "nth"], "left").withColumn("gap", F.col("page") - F.col("_last")).drop("_last")


def peephole_groups(pages: DataFrame, gap: int = 4) -> DataFrame:
    """Pages with at most ``gap`` clean ones between neighbours go together: ``generation, dim, pg_first, pg_last, n_pages``."""
    keys = ["generation", "dim"]
    new = F.when(F.col("gap") <= gap + 1, 0).otherwise(1)
    rows = running(with_gap(pages, keys), keys, "page", new, "g")
    out = rows.groupBy(*keys, "g").agg(F.min("page").alias("pg_first"), F.max("page").alias("pg_last"), F.count("*").alias("n_pages"))
    return out.drop("g")


def in_steps(pages: DataFrame, budget: int) -> DataFrame:
    """``pages`` with ``step``: a generation's pages by dim and page, ``budget`` to a step."""
    sizes = pages.groupBy("generation", "dim").agg(F.count("*").alias("n"))
    before = Window.partitionBy("generation").orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("generation", "dim", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row a dim
    rows = with_gap(pages, ["generation", "dim"]).join(sizes, ["generation", "dim"])
    return rows.withColumn("step", F.floor((F.col("nth") - 1 + F.col("before")) / budget).cast("long")).withColumn("place", (F.col("nth") - 1 + F.col("before")) % budget)


def step_pieces(pages: DataFrame, budget: int = 64) -> DataFrame:
    """Checkpoint in steps of ``budget`` pages: ``generation, step, pages, pieces`` (runs, cut at the step)."""
    new = F.when((F.col("gap") == 1) & (F.col("place") > 0), 0).otherwise(1)
    return in_steps(pages, budget).groupBy("generation", "step").agg(F.count("*").alias("pages"), F.sum(new).alias("pieces"))


def step_progress(pages: DataFrame, budget: int = 64) -> DataFrame:
    """``generation, step, pages, done, status``: pages written by each step and so far; AGAIN while some are left, then OK."""
    steps = in_steps(pages, budget).groupBy("generation", "step").agg(F.count("*").alias("pages"), F.max("step").alias("_"))
    total = pages.groupBy("generation").agg(F.count("*").alias("total"))
    done = F.least((F.col("step") + 1) * budget, F.col("total"))
    return steps.join(total, "generation").select("generation", "step", "pages", done.alias("done"), F.when(done < F.col("total"), "AGAIN").otherwise("OK").alias("status"))


def rows_on_dirty_pages(log: DataFrame, generation: int) -> DataFrame:
    """Page-granular delta: all rows on pages that a generation touched."""
    touched = dirty_pages(log).where(F.col("generation") == generation).select("dim", "page")
    return slots(log).join(touched, ["dim", "page"], "left_semi").select("feat_id", "dim", "entry_idx")


def unflushed(log: DataFrame, generation: int, budget: int = 64) -> DataFrame:
    """``feat_id, dim, page`` of the ids that a generation wrote and a flush of ``budget`` pages, the first in order, left buffered."""
    own = log.where(F.col("generation") == generation).select("dim", "feat_id").distinct()
    rows = slots(log).join(own, ["dim", "feat_id"], "left_semi")
    pages = rows.select(F.lit(generation).alias("generation"), "dim", "page").distinct()
    flushed = in_steps(pages, budget).where("step = 0").select("dim", "page")
    return rows.join(flushed, ["dim", "page"], "left_anti").select("feat_id", "dim", "page")


def run_chunks(runs: DataFrame, most: int = 1024) -> DataFrame:
    """``generation, dim, chunk, n_runs, n_pages``: runs in order, ``most`` to one write."""
    ranked = running(runs, ["generation", "dim"], "pg_start", F.lit(1), "nth")
    chunk = F.floor((F.col("nth") - 1) / most).cast("long").alias("chunk")
    return ranked.groupBy("generation", "dim", chunk).agg(F.count("*").alias("n_runs"), F.sum("pg_count").alias("n_pages"))


def entry_ranges(rows: DataFrame) -> DataFrame:
    """``dim, first, n``: ``rows(dim, entry_idx)`` as ranges of consecutive entries, as an export reads them."""
    ranked = running(rows.select("dim", "entry_idx"), ["dim"], "entry_idx", F.lit(1), "nth")
    islands = ranked.withColumn("island", F.col("entry_idx") - F.col("nth")).groupBy("dim", "island")
    return islands.agg(F.min("entry_idx").alias("first"), F.count("*").alias("n")).drop("island")
