"""Ignore rules judged for directories first, and for files only where no directory above them is left out."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, dirname
from ..sources.scratch import written

#: Rules (with those that directories inherit) that are sent to all tasks; more are met by key.
MOST_RULES = 20_000
#: Parts of the entries of one scope, where rules are met by key.
SALTS = 64

_compiled = lru_cache(maxsize=100_000)(lambda regex: re.compile("(?i)" + regex))


def _with_self(directory: Column) -> Column:
    return F.concat(ancestors(directory), F.array(directory))


def is_left_out(path: str, is_dir: bool, bare: bool, rules: Sequence[tuple]) -> bool:
    """By the last rule that fits: ``(size of its directory, is .ignore, ord, regex, negated)``, in order. ``bare``: a nested repository, which no ``.gitignore`` above reaches."""
    for size, is_ignore, _, regex, negated in reversed(rules):
        if bare and not is_ignore:
            continue
        inner = path[size + 1 :] if size else path
        if _compiled(regex).search(inner + "/" if is_dir else inner):
            return not negated
    return False


def rule_sets(rules: DataFrame) -> DataFrame:
    """``(repo, scope, rules)``: for each directory with rules, or that is a nested repository, all rules in force below it.

    ``rules(repo, dir, source, ord, regex, negated, stops)``. Those of the directories above come first; a ``.gitignore``
    above the nearest nested repository is not in force.
    """
    inner = rules.select("repo", F.explode("stops").alias("dir")).distinct()
    nodes = rules.select("repo", "dir").unionByName(inner).distinct()
    chain = F.when(F.col("dir") == ".", F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), _with_self(F.col("dir"))))
    up = nodes.select("repo", F.col("dir").alias("scope"), F.explode(chain).alias("dir"))
    nearest = up.join(inner, ["repo", "dir"]).groupBy("repo", "scope").agg(F.max(F.length("dir")).alias("least"))
    size = F.when(F.col("dir") == ".", 0).otherwise(F.length("dir"))
    met = up.join(rules.drop("stops"), ["repo", "dir"]).join(nearest, ["repo", "scope"], "left").filter((F.col("source") != ".gitignore") | F.col("least").isNull() | (size >= F.col("least")))
    rule = F.struct(size.alias("size"), (F.col("source") == ".ignore").alias("is_ignore"), F.col("ord").cast("int").alias("ord"), "regex", "negated")
    return met.groupBy("repo", "scope").agg(F.sort_array(F.collect_list(rule)).alias("rules"))


def shared_rules(sets: DataFrame) -> dict | None:
    """The rules of each scope, or None if there are more than ``MOST_RULES``."""
    found: dict[tuple, list] = {}
    rows = sets.select("repo", "scope", F.explode("rules").alias("rule")).limit(MOST_RULES + 1).collect()
    for r in rows:
        found.setdefault((r["repo"], r["scope"]), []).append(tuple(r["rule"]))
    return {k: sorted(v) for k, v in found.items()} if len(rows) <= MOST_RULES else None


def judged(entries: DataFrame, sets: DataFrame, shared: Broadcast | None) -> DataFrame:
    """``(repo, path)`` of the entries ``(repo, scope, path, is_dir, bare)`` that their scope's rules leave out.

    Up to ``MOST_RULES`` rules are there in all tasks (``shared``). More of them meet the entries by scope, in ``SALTS`` parts: a part's
    rules come first and its entries stream by, so no group is held and no entry carries rules.
    """
    if shared is not None:

        @F.pandas_udf("boolean")
        def out(repo: pd.Series, scope: pd.Series, path: pd.Series, is_dir: pd.Series, bare: pd.Series) -> pd.Series:
            found = shared.value
            return pd.Series([is_left_out(p, d, b, found.get((r, s), ())) for r, s, p, d, b in zip(repo, scope, path, is_dir, bare)], dtype=bool)

        return entries.filter(out("repo", "scope", "path", "is_dir", "bare")).select("repo", "path")
    salts = sets.select("repo", "scope", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("boolean").alias("is_dir"), F.lit(None).cast("boolean").alias("bare"), "rules")
    rows = entries.select("repo", "scope", F.pmod(F.hash("path"), F.lit(SALTS)).alias("salt"), "path", "is_dir", "bare", F.lit(None).cast(sets.schema["rules"].dataType).alias("rules"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rules = None, []
        for batch in batches:
            out = []
            for repo, scope, path, is_dir, bare, own in batch[["repo", "scope", "path", "is_dir", "bare", "rules"]].itertuples(index=False, name=None):
                if path is None or path != path:
                    at, rules = (repo, scope), [(x["size"], x["is_ignore"], x["ord"], x["regex"], x["negated"]) for x in own]
                elif (repo, scope) == at and is_left_out(path, is_dir, bare, rules):
                    out.append((repo, path))
            yield pd.DataFrame(out, columns=["repo", "path"], dtype=object)

    kinds = f"repo {entries.schema['repo'].dataType.simpleString()}, path string"
    return salts.unionByName(rows).repartition("repo", "scope", "salt").sortWithinPartitions("repo", "scope", "salt", F.col("path").asc_nulls_first()).mapInPandas(run, kinds)


def walked(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``ignored_at``, the number of the first component that is left out, to ``files(repo, path, ...)``.

    Directories are told apart first: a table of the distinct ones, far smaller than that of files, gets each one's scope
    (the nearest directory at or above it with rules), is judged once, and the excluded ones pass their verdict to all below;
    so no pass is needed for each level. A file then meets its own directory's row alone, and only files whose directory
    stays are judged. The largest key is a directory's children.
    """
    rules = written(rules, "rules")
    sets = rule_sets(rules)
    found = shared_rules(sets)
    if found is None:
        sets, shared = written(sets, "rule-sets"), None
    else:
        shared = files.sparkSession.sparkContext.broadcast(found)
    inner = rules.select("repo", F.explode("stops").alias("dir")).distinct()
    nodes = rules.select("repo", F.col("dir").alias("scope")).unionByName(inner.withColumnRenamed("dir", "scope")).distinct()
    own = files.select("repo", dirname(F.col("path")).alias("dir")).filter("dir <> '.'").distinct()
    dirs = own.select("repo", F.explode(_with_self(F.col("dir"))).alias("dir")).distinct()
    near = lambda c: F.max(F.when(c, F.struct(F.length("scope").alias("n"), "scope")))["scope"]
    scopes = dirs.select("repo", "dir", F.explode(_with_self(F.col("dir"))).alias("scope")).join(nodes.withColumn("hit", F.lit(True)), ["repo", "scope"], "left")
    scopes = scopes.groupBy("repo", "dir").agg(near(F.col("hit")).alias("scope"), near(F.col("hit") & (F.col("scope") != F.col("dir"))).alias("outer"))
    scoped = scopes.join(inner.withColumn("bare", F.lit(True)), ["repo", "dir"], "left")
    scoped = written(scoped.select("repo", "dir", *[F.coalesce(c, F.lit(".")).alias(c) for c in ("scope", "outer")], F.coalesce("bare", F.lit(False)).alias("bare")), "scopes")
    gone = judged(scoped.select("repo", F.col("outer").alias("scope"), F.col("dir").alias("path"), F.lit(True).alias("is_dir"), "bare"), sets, shared)
    gone = gone.select("repo", F.col("path").alias("above"), F.size(F.split("path", "/")).alias("at"))
    below = scoped.select("repo", "dir", F.explode(_with_self(F.col("dir"))).alias("above")).join(gone, ["repo", "above"]).groupBy("repo", "dir").agg(F.min("at").alias("dir_at"))
    info = written(scoped.join(below, ["repo", "dir"], "left").select("repo", F.col("dir").alias("_dir"), F.col("scope").alias("_scope"), F.col("dir_at").alias("_dir_at")), "verdicts")
    met = files.withColumn("_dir", dirname(F.col("path"))).join(info, ["repo", "_dir"], "left")
    left = met.filter("_dir_at is null").select("repo", F.coalesce("_scope", F.lit(".")).alias("scope"), "path", F.lit(False).alias("is_dir"), F.lit(False).alias("bare"))
    out = judged(left, sets, shared).distinct().withColumn("_out", F.lit(True))
    at = F.coalesce("_dir_at", F.when(F.col("_out"), F.size(F.split("path", "/"))))
    return met.join(out, ["repo", "path"], "left").withColumn("ignored_at", at).select(*files.columns, "ignored_at")
