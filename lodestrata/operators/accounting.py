"""Request logs, costs, cohorts and rates. What is unknown stays unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import known_sum, micros, sum_or_unknown


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind").agg(F.count("*").alias("n"))


LOGS = ("starts", "ends", "requests", "responses")


def reconcile_log(starts: DataFrame, ends: DataFrame, requests: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    """Each id with how often it stands in each of four logs, and ``matched``: once in all of them, and with the sizes and status of an answer that came through.

    ``starts(key)``, ``ends(key, status, request_bytes, response_bytes, incomplete, error)``, ``requests(key, bytes)``, ``responses(key, bytes)``.
    Sizes sent and received are those of the files kept; an end after the reader has gone (``BrokenPipeError``) may
    have delivered less. Logs are counted before they meet, so a repeated id costs a row a task. A null id is matched with nothing.
    """
    parts = {
        "starts": starts.groupBy(key).agg(F.count("*").alias("n_starts")),
        "ends": ends.groupBy(key).agg(F.count("*").alias("n_ends"), *[F.max(c).alias(c) for c in ("status", "request_bytes", "response_bytes", "incomplete", "error")]),
        "requests": requests.groupBy(key).agg(F.count("*").alias("n_requests"), F.max("bytes").alias("_sent")),
        "responses": responses.groupBy(key).agg(F.count("*").alias("n_responses"), F.max("bytes").alias("_kept")),
    }
    both = parts["starts"]
    for name in LOGS[1:]:
        both = both.join(parts[name], key, "full")
    counts = {f"n_{x}": F.coalesce(f"n_{x}", F.lit(0)) for x in LOGS}
    once = F.col(key).isNotNull()
    for x in LOGS:
        once &= F.col(f"n_{x}") == 1
    left_early = (F.col("error") == "BrokenPipeError") & F.col("response_bytes").between(0, F.col("_kept"))
    whole = F.coalesce(left_early, F.lit(False)) | (F.col("error").isNull() & F.coalesce(F.col("response_bytes") == F.col("_kept"), F.lit(False)))
    good = F.coalesce((F.col("status") == 200) & ~F.coalesce("incomplete", F.lit(False)) & (F.col("request_bytes") == F.col("_sent")), F.lit(False)) & whole
    return both.withColumns(counts).withColumn("matched", once & good).select(key, *counts, "matched")


def log_covered(reconciled: DataFrame) -> DataFrame:
    """One row: the ids, and whether every one is matched; true for empty logs."""
    return reconciled.agg(F.count("*").alias("ids"), F.coalesce(F.bool_and("matched"), F.lit(True)).alias("covered"))


def id_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: ids on both sides and on one only, and whether the sets are equal and without repeats."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    both = a.join(b, key, "full")
    n, m = F.col("n_left"), F.col("n_right")
    return both.agg(
        F.count_if(n.isNotNull() & m.isNotNull()).alias("both"),
        F.count_if(m.isNull()).alias("left_only"),
        F.count_if(n.isNull()).alias("right_only"),
        F.coalesce(F.bool_and(n.eqNullSafe(F.lit(1)) & m.eqNullSafe(F.lit(1))), F.lit(True)).alias("covered"),
    )


def compare_to_baseline(attempts: DataFrame, baselines: DataFrame) -> DataFrame:
    """Attempts beside their task's baseline; differences are null where a side is unknown."""
    b = baselines.select("task", F.col("resolved").alias("baseline_resolved"), F.col("cost").alias("baseline_cost"))
    return attempts.join(b, "task", "left").withColumn("saved", F.col("baseline_cost") - F.col("cost"))


# States in which an attempt is over.
TERMINAL = ("completed", "failed", "interrupted")


def cohort_summary(compared: DataFrame, keys: list[str]) -> DataFrame:
    """Solves, preserved solves, wins by cost and totals that are null unless all parts are known.

    ``all_terminal``: every attempt's ``status`` is one of ``TERMINAL``; ``all_graded``: and each was ``graded``. A null is neither.
    """
    terminal = F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))
    won = F.col("resolved") & (F.col("cost") < F.col("baseline_cost"))
    return compared.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        F.count_if("resolved").alias("solved"),
        F.count_if(F.col("resolved") & F.col("baseline_resolved")).alias("preserved"),
        F.count_if(won).alias("cost_wins"),
        F.bool_and(terminal).alias("all_terminal"),
        F.bool_and(terminal & F.coalesce("graded", F.lit(False))).alias("all_graded"),
        F.bool_and(F.col("cost").isNotNull()).alias("all_known"),
        sum_or_unknown(F.col("cost")).alias("total_cost"),
        known_sum(F.col("cost")).alias("known_cost"),
    )


def cost_ratios(cohort: DataFrame) -> DataFrame:
    """Cost of an attempt and of a solve; null where none solve or the total is unknown."""
    return cohort.withColumns({"per_attempt": F.try_divide("total_cost", "attempts"), "per_solve": F.try_divide("total_cost", "solved")})


def median_of_medians(runs: DataFrame, keys: list[str], sample: str, value: str) -> DataFrame:
    """The median over samples of each sample's median."""
    inner = runs.groupBy(*keys, sample).agg(F.median(value).alias("m"))
    return inner.groupBy(*keys).agg(F.median("m").alias("median"), F.count("*").alias("samples"))


def compare_arms(bench: DataFrame, keys: list[str], arm: str, value: str, before: str, after: str, output: str | None = None) -> DataFrame:
    """Both arms of each key side by side, with the relative change.

    With ``output``, a column of output hashes, also ``same_output``: all rows of both arms have one and the same; false
    where one is unknown or an arm has no rows.
    """
    wide = bench.groupBy(*keys).pivot(arm, [before, after]).agg(F.median(value))
    change = F.try_divide(F.col(after) - F.col(before), F.col(before)).alias("change")
    wide = wide.select(*keys, F.col(before).alias("before"), F.col(after).alias("after"), change)
    if output is None:
        return wide
    own = bench.filter(F.col(arm).isin(before, after))
    same = (F.min(output) == F.max(output)) & (F.count(output) == F.count("*")) & (F.min(arm) != F.max(arm))
    hashes = own.groupBy(*keys).agg(F.coalesce(same, F.lit(False)).alias("same_output"))
    matched = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    renamed = hashes.select(*[F.col(k).alias(f"_{k}") for k in keys], "same_output")
    return wide.join(renamed, matched, "left").select(*wide.columns, F.coalesce("same_output", F.lit(False)).alias("same_output"))


def latency_percentiles(log: DataFrame, keys: list[str], value: str, ps=(0.5, 0.95), exact: bool = True) -> DataFrame:
    f = F.percentile if exact else F.percentile_approx
    return log.groupBy(*keys).agg(F.count("*").alias("n"), *[f(value, F.lit(p)).alias(f"p{round(p * 100)}") for p in ps])


def sketch(log: DataFrame, keys: list[str], value: str, ident: str) -> DataFrame:
    """``(*keys, n, quantiles, distinct)``: a KLL sketch of the values and an HLL sketch of the ids of each key.

    Sketches are columns that can be stored and merged over keys and batches (:func:`merge_sketches`), which percentiles and
    distinct counts can't. Null values and ids are left out of theirs.
    """
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("quantiles"), F.hll_sketch_agg(F.col(ident).cast("string")).alias("distinct"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The same of the unions of rows by ``keys``: of coarser keys, or of several batches."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def read_sketches(sketches: DataFrame, ps=(0.5, 0.95)) -> DataFrame:
    """Percentiles, within 2 % of the ranks, and distinct ids, within 5 %, nearly always; null without values."""
    made = [F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))).alias(f"p{round(p * 100)}") for p in ps]
    return sketches.select(*[c for c in sketches.columns if c not in ("quantiles", "distinct")], *made, F.hll_sketch_estimate("distinct").alias("distinct"))


def size_ratchet(current: DataFrame, previous: DataFrame, renames: DataFrame, max_tokens: int = 8000) -> DataFrame:
    """Files over the budget that are new or grew, each beside its size under the name it had."""
    origin = current.join(renames, "path", "left").withColumn("origin", F.coalesce("old_path", "path"))
    before = previous.select(F.col("path").alias("origin"), F.col("tokens").alias("old_tokens"))
    both = origin.join(before, "origin", "left")
    return both.filter((F.col("tokens") > max_tokens) & (F.col("old_tokens").isNull() | (F.col("tokens") > F.col("old_tokens")))).select("path", "origin", "tokens", "old_tokens")


def oversized_sources(files: DataFrame, max_tokens: int = 8000) -> DataFrame:
    return files.filter(F.col("tokens") > max_tokens).orderBy(F.desc("tokens"), "path")


def rolling_budget(log: DataFrame, keys: list[str], ts: str, tokens: str, seconds: int = 1) -> DataFrame:
    """Adds the requests and tokens of the last ``seconds``, a request's own included.

    Time is cut into stretches as long as the window, which so reaches from a request's own stretch into the one before it and
    no further. Each request is sent to its own stretch and, to be counted, to the next; a window runs within one stretch. So
    the requests of one worker are spread over as many tasks as there are stretches. A null time is in no window and gets nulls.
    """
    width = seconds * 1_000_000
    at = micros(F.col(ts))
    rows = log.withColumn("_at", at).withColumn("_own", F.floor(F.col("_at") / width))
    met = rows.withColumn("_stretch", F.explode_outer(F.array("_own", F.col("_own") + 1)))
    w = W.partitionBy(*keys, "_stretch").orderBy("_at").rangeBetween(-(width - 1), 0)
    known = F.col("_at").isNotNull()
    counted = met.withColumn("requests_in_window", F.when(known, F.count("*").over(w))).withColumn("tokens_in_window", F.when(known, F.sum(tokens).over(w)))
    own = counted.filter(F.col("_own") == F.col("_stretch")).drop("_at", "_own", "_stretch")
    none = rows.filter(~known).drop("_at", "_own").withColumns({"requests_in_window": F.lit(None).cast("long"), "tokens_in_window": F.lit(None).cast(counted.schema["tokens_in_window"].dataType)})
    return own.unionByName(none)


def in_cooldown(log: DataFrame, keys: list[str], ts: str, end: str) -> DataFrame:
    """Adds the latest end of a cooldown that an earlier request started, and whether it still holds."""
    earlier = W.partitionBy(*keys).orderBy(ts, "event_id").rowsBetween(W.unboundedPreceding, -1)
    until = F.max(end).over(earlier)
    return log.withColumn("until", until).withColumn("cooling", F.coalesce(micros(until) > micros(F.col(ts)), F.lit(False)))


def evict_oldest(answers: DataFrame, max_bytes: int, block: int = 4096) -> DataFrame:
    """The answers to drop, oldest first, until seven eighths of the bound hold the rest; sizes are whole blocks.

    Sums by day come first; only days that are cut or older are walked in order.
    """
    sized = answers.withColumn("size", F.ceil(F.col("bytes") / block) * block).withColumn("_day", F.to_date("created_at"))
    days = sized.groupBy("_day").agg(F.sum("size").alias("_s"))
    run = days.withColumn("_before", F.sum("_s").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1))).withColumn("_all", F.sum("_s").over(W.partitionBy()))
    goal = F.when(F.col("_all") > max_bytes, F.col("_all") - F.lit(max_bytes * 7 / 8)).otherwise(F.lit(0.0))
    cut = run.select("_day", F.coalesce("_before", F.lit(0)).alias("_before"), goal.alias("_goal")).filter("_goal > _before")
    w = W.partitionBy("_day").orderBy("created_at", "digest").rowsBetween(W.unboundedPreceding, -1)
    own = sized.join(cut, "_day").withColumn("_so_far", F.col("_before") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    return own.filter("_so_far < _goal").select("digest", "created_at", "size")


def work_clock(events: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds of work and of credited waiting: time during which only retrieval commands are active is credited.

    ``events(..., ts, retrieval boolean, delta +1 or -1)``.
    """
    w = W.partitionBy(*keys).orderBy("ts", "event_id")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    swept = (
        events.withColumn("r", F.sum(F.when(F.col("retrieval"), F.col("delta")).otherwise(0)).over(run))
        .withColumn("o", F.sum(F.when(F.col("retrieval"), 0).otherwise(F.col("delta"))).over(run))
        .withColumn("micros", micros(F.lead("ts").over(w)) - micros(F.col("ts")))
    )
    credited = (F.col("r") > 0) & (F.col("o") <= 0)
    return swept.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(credited, F.col("micros"))), F.lit(0)).alias("credited_micros"),
        F.coalesce(F.sum(F.when(~credited, F.col("micros"))), F.lit(0)).alias("work_micros"),
    )


def latest_attempt(attempts: DataFrame, keys: list[str], order: str) -> DataFrame:
    return attempts.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
