"""Refresh runs, guards and the state of the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import progress_percent

#: Hours in which the last good run counts as fresh, and minutes after which a running one has failed.
FRESH_HOURS, FRESH_DEAL_HOURS, STALE_MINUTES = 24, 4, 30


def activation_guard(staged: int, active: int, all_ok: bool) -> bool:
    """Whether staged rows may replace active ones: all chains are in, or enough rows are, or there was little before."""
    return staged > 0 and (all_ok or active < 1000 or staged >= max(500, int(0.3 * active)))


def guard_column(staged: Column, active: Column, all_ok: Column) -> Column:
    enough = staged >= F.greatest(F.lit(500), F.floor(active * 0.3))
    return (staged > 0) & (all_ok | (active < 1000) | enough)


def latest_runs(runs: DataFrame, ok_only: bool = False) -> DataFrame:
    """The newest run of each kind."""
    rows = runs.where("status = 'done'") if ok_only else runs
    return rows.groupBy("kind").agg(F.max(F.struct("started_at", "run_id", *[c for c in runs.columns if c not in ("kind", "started_at", "run_id")])).alias("run")).select("kind", "run.*")


def catalog_fresh(runs: DataFrame, now: Column, hours: int = FRESH_HOURS) -> DataFrame:
    """Of each kind, whether its last successful run ended within the hours before now."""
    last = runs.where("status = 'done'").groupBy("kind").agg(F.max("finished_at").alias("finished_at"))
    return last.select("kind", "finished_at", (F.col("finished_at") >= now - F.expr(f"INTERVAL {hours} HOURS")).alias("fresh"))


def fail_stale_runs(runs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return runs.withColumn("error", F.when(stale, F.lit("timed out")).otherwise(F.col("error"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def run_view(runs: DataFrame) -> DataFrame:
    lists = [c for c in runs.columns if runs.schema[c].dataType.typeName() == "array"]
    return runs.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})


def failed_chains(asked: DataFrame, succeeded: DataFrame) -> DataFrame:
    return asked.select("chain").join(succeeded.select("chain"), "chain", "left_anti")


def run_rollup(results: DataFrame) -> DataFrame:
    """Products, stores and errors of each chain and in all; the time in all is the longest chain's."""
    chains = results.groupBy("chain").agg(F.sum("products").alias("products"), F.countDistinct("store_id").alias("stores"), F.sum("errors").alias("errors"), F.sum("seconds").alias("seconds"))
    total = chains.rollup("chain").agg(F.sum("products").alias("products"), F.sum("stores").alias("stores"), F.sum("errors").alias("errors"), F.max("seconds").alias("seconds"))
    return total.withColumn("chain", F.coalesce("chain", F.lit("TOTAL")))


def log_product_counts(lines: DataFrame) -> DataFrame:
    """The chain and the number of products that log lines tell, summed by chain."""
    told = lines.select("chain", F.regexp_extract("line", r"[—-]\s*(\d+) products", 1).try_cast("long").alias("n"))
    return told.where("n is not null").groupBy("chain").agg(F.sum("n").alias("products"))


def branch_metadata(branches: DataFrame, products: DataFrame) -> DataFrame:
    """branches and, for stores that only products name, a row without more."""
    named = products.select("chain", "store_id").distinct().join(branches, ["chain", "store_id"], "left_anti")
    return branches.unionByName(named, allowMissingColumns=True)


def lists_by_recency(lists: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "list_id"))
    return lists.withColumn("place", place)


def refresh_deals_plan(batches: DataFrame) -> DataFrame:
    """Chains whose deals may be replaced: those that have rows and no error."""
    return batches.groupBy("chain").agg(F.sum("rows").alias("rows"), F.sum("errors").alias("errors")).where("rows > 0 and errors = 0").select("chain")


def run_progress(runs: DataFrame, lines: DataFrame, chains: int) -> DataFrame:
    """Of each run that is running: chains started, fetched and done, products so far, and progress in percent of so many chains.

    lines: (run_id, chain, step, products), step one of started, fetched, done and failed. The products of a chain are the most that a line tells.
    """
    steps = lines.groupBy("run_id", "chain").agg(F.max("products").alias("products"), *(F.max(F.col("step").isin(*names)).alias(told) for told, names in (("started", ["started"]), ("fetched", ["fetched", "done", "failed"]), ("done", ["done", "failed"]))))
    sums = steps.groupBy("run_id").agg(F.sum("products").alias("products"), *(F.count_if(c).alias(f"chains_{c}") for c in ("started", "fetched", "done")))
    told = runs.where("status = 'running'").join(sums, "run_id", "left").na.fill(0, ["products", "chains_started", "chains_fetched", "chains_done"])
    counts = [F.least(f"chains_{c}", F.lit(chains)) for c in ("done", "fetched", "started")]
    return told.select("run_id", "kind", "started_at", "chains_started", "chains_fetched", "chains_done", "products", progress_percent(*counts, F.lit(chains), F.lit(False)).alias("progress_percent"))


def catalog_status(runs: DataFrame, chain_counts: DataFrame, now: Column, lines: DataFrame | None = None) -> DataFrame:
    """One row: the last run and last good run of each kind, freshness of prices and deals, all chains' counts and, with lines, active: the newest running run's progress."""
    last = latest_runs(runs).agg(F.map_from_entries(F.collect_list(F.struct("kind", "status"))).alias("last_status"))
    good = latest_runs(runs, ok_only=True).agg(F.map_from_entries(F.collect_list(F.struct("kind", "finished_at"))).alias("last_success"))
    fresh = catalog_fresh(runs, now).agg(F.map_from_entries(F.collect_list(F.struct("kind", "fresh"))).alias("fresh"))
    counts = chain_counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chain", "product_count")))).alias("chains"))  # a row for each chain
    parts = [last, good, fresh, counts]
    if lines is not None:
        progress = run_progress(runs, lines, chain_counts.count())
        parts.append(progress.agg(F.max_by(F.struct(*progress.columns), F.struct("started_at", "run_id")).alias("active")))
    one = [f.withColumn("_one", F.lit(1)) for f in parts]
    return reduce(lambda a, b: a.join(b, "_one"), one).drop("_one")


def run_log(results: DataFrame, swapped: Column) -> DataFrame:
    """A row for each run of results (run_id, kind, chain, rows, error): its status, its chains, and its errors.

    A run is done if its staged rows were swapped in (swapped, a condition on the aggregated row), else failed. Errors are those of
    its chains, then partial_refresh if some chain failed, and swap_skipped if nothing was swapped.
    """
    good = (F.col("rows") > 0) & F.col("error").isNull()
    sums = results.groupBy("run_id", "kind").agg(
        F.sort_array(F.collect_set("chain")).alias("chains_requested"), F.sort_array(F.collect_set(F.when(good, F.col("chain")))).alias("chains_succeeded"), F.sort_array(F.collect_set(F.when(~good, F.col("chain")))).alias("chains_failed"),
        F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "chain", "error")))).alias("told"), F.sum("rows").alias("rows"), F.count_if(~good).alias("failures"),
    )
    done = sums.withColumn("swapped", F.coalesce(swapped, F.lit(False)))
    notes = F.array_compact(F.array(F.when(F.col("failures") > 0, F.lit("partial_refresh")), F.when(~F.col("swapped"), F.lit("swap_skipped"))))
    return done.select("run_id", "kind", F.when(F.col("swapped"), "done").otherwise("failed").alias("status"), "chains_requested", "chains_succeeded", "chains_failed", F.concat("told", notes).alias("errors"), "rows")
