"""Scores, answers, money and unknown-aware sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,12)"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of either kind of timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def request_digest(namespace: Column, request: Column, schema: int = 1) -> Column:
    """Identity of a request; the order of its fields counts."""
    return F.sha2(F.to_json(F.struct(F.lit(schema).alias("schema"), namespace.alias("namespace"), request.alias("request"))), 256)


def unit_value(q: Column, scope: Column, ref: Column) -> Column:
    """Relevance within its scope, or a concrete reference."""
    return F.greatest(F.least(q, scope), F.coalesce(ref, F.lit(0.0)))


def role_labels(answers: Column, threshold: float = 0.5) -> Column:
    """Names, sorted, with a probability over the threshold, but for ``priority``."""
    return F.array_sort(F.map_keys(F.map_filter(answers, lambda k, v: (k != "priority") & (v > threshold))))


def run_status(interrupted: Column, n_issues: Column) -> Column:
    return F.when(interrupted, "interrupted").when(n_issues > 0, "incomplete").otherwise("complete")


def usage_cost(tokens: Column, model: Column, rates: dict[str, str]) -> Column:
    """Exact price of ``tokens`` at ``rates`` for a million; null for an unknown model or unknown usage."""
    rate = F.lit(None).cast("decimal(10,6)")
    for name, price in rates.items():
        rate = F.when(model == name, F.lit(price).cast("decimal(10,6)")).otherwise(rate)
    return (tokens.cast("decimal(18,0)") * rate * F.lit("0.000001").cast("decimal(7,6)")).cast(MONEY)


def answer_is_fresh(created_at: Column, now: Column, ttl_seconds: int = 7 * 86400) -> Column:
    """An answer from the future is not."""
    age = micros(now) - micros(created_at)
    return F.coalesce((age >= 0) & (age < ttl_seconds * 1_000_000), F.lit(False))


def cooldown_end(ts: Column, retry_after: Column, default_seconds: int = 1) -> Column:
    """From a number of seconds or an HTTP date, else after ``default_seconds``."""
    seconds = retry_after.try_cast("double")
    date = F.try_to_timestamp(F.regexp_extract(retry_after, r"^\w{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    after = F.when(seconds >= 0, seconds)
    wait = F.timestamp_micros((micros(ts) + F.coalesce(after, F.lit(float(default_seconds))) * 1_000_000).cast("long"))
    return F.when(after.isNull() & (date > ts.cast("timestamp")), date).otherwise(wait)


def usage_field(json: Column, names: tuple[str, ...]) -> Column:
    """The first of several spellings of a count."""
    return F.coalesce(*[F.get_json_object(json, f"$.{n}") for n in names]).try_cast("long")


def sum_or_unknown(col: Column) -> Column:
    """Null unless every part is known."""
    return F.when(F.bool_and(col.isNotNull()), F.sum(col))


def known_sum(col: Column) -> Column:
    """What the known parts add up to; 0 where there are none."""
    return F.coalesce(F.sum(col), F.lit(0))


def type_set(only: Column, exclude: Column) -> Column:
    """Sorted categories to keep; an excluded one is out whatever else says so."""
    return F.array_sort(F.array_except(F.array_distinct(only), exclude))
