"""Scores of items for questions, gates by directory, and what is looked up or asked again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..functions.text import identifiers
from ..functions.values import answer_is_fresh
from .sized import sized


def token_matches(items: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, item_id, matched)``: the distinct lower-case identifiers of a query in each item's text.

    The queries' tokens are few and go to where the items are (see :func:`sized`), so that items' tokens aren't exchanged and an
    item's matches are counted in its task; an item without one of a query's tokens has no row for it.
    """
    def tokens(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.array_distinct(F.transform(identifiers(F.col("text")), F.lower))).alias("token"))

    return tokens(items, "item_id").join(sized(tokens(queries, "query_id")), "token").groupBy("query_id", "item_id").agg(F.count("*").alias("matched"))


def lexical_scorer(items: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, item_id, score)``: matched identifiers by all of the query's, for pairs with a match; others score 0."""
    size = queries.select("query_id", F.size(F.array_distinct(F.transform(identifiers(F.col("text")), F.lower))).alias("n"))
    return token_matches(items, queries).join(size, "query_id").select("query_id", "item_id", (F.col("matched") / F.col("n")).alias("score"))


def score(items: DataFrame, queries: DataFrame, scorer: Callable[[DataFrame, DataFrame], DataFrame] = lexical_scorer) -> DataFrame:
    """Scores by any function of the same form; a model's is a ``mapInPandas`` over the pairs that are asked."""
    return scorer(items, queries)


def pair_items(queries: DataFrame, items: DataFrame, gate: DataFrame) -> DataFrame:
    """Questions with the items that their gate ``(query_id, item_id)`` lets through."""
    return gate.join(queries, "query_id").join(items, "item_id")


def admit(scored: DataFrame, relevant: float = 0.5, strong: float = 0.6, lead: float = 0.25, display: float = 0.7) -> DataFrame:
    """Adds ``relevant``, ``strong``, ``lead`` and ``display``. Only ``strong`` admits its own bound."""
    s = F.col("score")
    return scored.withColumns({"relevant": s > relevant, "strong": s >= strong, "lead": s > lead, "display": s > display})


def admitted_files(scored: DataFrame, relevant: float = 0.5) -> DataFrame:
    return scored.filter(F.col("score") > relevant)


def best_chunk_score(scored: DataFrame) -> DataFrame:
    """The best score over a file's chunks, and the first chunk that has it."""
    return scored.groupBy("query_id", "path").agg(F.max("score").alias("score"), F.max_by("chunk", F.struct("score", -F.col("chunk"))).alias("chunk"))


def suppress_floods(scored: DataFrame, min_weak: int = 32, relevant: float = 0.5, strong: float = 0.6) -> DataFrame:
    """Admitted items of one wave; where a query has many weak ones and no strong one, none of the weak.

    :func:`waves.traverse` tests each wave, with the strong scores of those before in mind.
    """
    s = F.col("score")
    flood = scored.groupBy("query_id").agg(((F.count_if((s > relevant) & (s < strong)) >= min_weak) & ~F.bool_or(s >= strong)).alias("flood"))
    return scored.join(flood, "query_id").filter((s > relevant) & (~F.col("flood") | (s >= strong))).drop("flood")


def distinct_requests(questions: DataFrame) -> DataFrame:
    """One row for each digest, with the number of times it is asked."""
    return questions.groupBy("digest").agg(F.min("question").alias("question"), F.count("*").alias("asked"))


def lookup_answers(questions: DataFrame, answers: DataFrame, now, ttl_seconds: int = 7 * 86400) -> tuple[DataFrame, DataFrame]:
    """Questions with a fresh answer, and those to be asked."""
    fresh = answers.filter(answer_is_fresh(F.col("created_at"), now, ttl_seconds))
    return questions.join(fresh, "digest"), questions.join(fresh.select("digest"), "digest", "left_anti")


def valid_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """By digest, whether each question has a finite answer from 0 to 1."""
    p = F.col("probability")
    own = questions.join(answers, ["digest", "question_id"], "left")
    return own.groupBy("digest").agg(F.bool_and(F.coalesce(p.between(0, 1) & ~F.isnan(p), F.lit(False))).alias("valid"))


def reachable_files(files: DataFrame, dir_scores: DataFrame, relevant: float = 0.5) -> DataFrame:
    """Files whose ancestor directories at even depths all are admitted for a query.

    ``files(path)``, ``dir_scores(query_id, dir, score)``. A directory without a score is not admitted.
    """
    queries = sized(dir_scores.select("query_id").distinct())
    steps = files.select("path", F.posexplode_outer(ancestors(F.col("path"))).alias("i", "dir"))
    gates = steps.filter("i is null or (i + 1) % 2 = 0").select("path", "dir")
    free = files.join(gates.select("path"), "path", "left_anti").select("path").crossJoin(queries)
    need = gates.filter("dir is not null").groupBy("path").agg(F.count("*").alias("need"))
    got = gates.join(dir_scores.filter(F.col("score") > relevant), "dir").groupBy("query_id", "path").agg(F.count("*").alias("got"))
    through = got.join(need, "path").filter("got = need").select("query_id", "path")
    root = files.filter(~F.col("path").contains("/")).select("path").crossJoin(queries)
    return through.unionByName(free.select("query_id", "path")).unionByName(root.select("query_id", "path")).distinct()


def skip_seen(frontier: DataFrame, visited: DataFrame, keys: list[str]) -> DataFrame:
    return frontier.join(visited.select(*keys), keys, "left_anti")


def check_freshness(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``state``: ``same``, ``changed`` or ``missing``, by content hash."""
    now = files.select("repo", "path", F.col("content_hash").alias("_now"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("_now").eqNullSafe(F.col("content_hash")), "same").otherwise("changed")
    return candidates.join(now, ["repo", "path"], "left").withColumn("state", state).drop("_now", "_there")


def navigation_budget(batches: DataFrame, max_bytes: int = 8_000_000) -> DataFrame:
    """Adds the bytes so far of each query and whether a batch is within the budget, from the first byte on.

    :func:`waves.traverse` heeds the budget only once there are many positive scores and no confident source.
    """
    w = W.partitionBy("query_id").orderBy("batch").rowsBetween(W.unboundedPreceding, 0)
    return batches.withColumn("so_far", F.sum("bytes").over(w)).withColumn("within", F.col("so_far") <= max_bytes)


def pick_probe(scored: DataFrame, probed: DataFrame) -> DataFrame:
    """The last probe: the best file of each query that was not probed yet; the first path among equals. Those before it are made by :func:`waves.traverse`."""
    rest = skip_seen(scored, probed, ["query_id", "path"])
    return rest.groupBy("query_id").agg(F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("path"), F.max("score").alias("score"))


def union_waves(*waves: DataFrame) -> DataFrame:
    out = waves[0]
    for wave in waves[1:]:
        out = out.unionByName(wave)
    return out.distinct()
