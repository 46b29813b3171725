"""Queries on scores, answers and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import retrieval as R
from ..operators import waves as T
from ..operators.accounting import issue_counts
from .mapping import FILES, SCORES, files, scores, table

_NOW = "timestamp '2024-02-02 00:00:00'"
_IDS = "list_distinct(list_transform(regexp_extract_all(text, '[_\\p{L}\\p{Nl}][_\\p{L}\\p{Nl}\\p{Nd}\\p{Mn}\\p{Mc}\\p{Pc}]*'), lambda x: lower(x)))"
_TOKENS = f"""i AS (SELECT doc_id AS item_id, unnest({_IDS}) AS t FROM documents), q AS (SELECT item_id AS query_id, unnest({_IDS}) AS t FROM benchmark)"""
_ANSWERS = f"""questions AS (SELECT event_id, user_id AS digest FROM events), answers AS (SELECT user_id AS digest, max(ts) AS created_at FROM events WHERE event_type = 'view' AND user_id % 4 > 0 GROUP BY 1),
 fresh AS (SELECT * FROM answers WHERE created_at <= {_NOW} AND epoch_us({_NOW}) - epoch_us(created_at) < 604800000000)"""


def _answers(s, d):
    e = table(s, d, "events")
    answers = e.filter("event_type = 'view' and user_id % 4 > 0").groupBy(F.col("user_id").alias("digest")).agg(F.max("ts").alias("created_at"))
    return R.lookup_answers(e.select("event_id", F.col("user_id").alias("digest")), answers, F.expr(_NOW))


def _texts(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def f15(s, d):
    e = table(s, d, "events")
    questions = e.select((F.col("user_id") % 50).alias("digest"), (F.col("event_id") % 20).alias("question_id")).distinct()
    answers = e.filter("event_type <> 'error'").groupBy((F.col("user_id") % 50).alias("digest"), (F.col("event_id") % 20).alias("question_id")).agg((F.min("value") / 3).alias("probability"))
    return R.valid_answers(questions, answers)


def j1(s, d):
    now = files(s, d).filter("doc_id % 5 > 0").select("repo", "path", F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("bytes").cast("string")).alias("content_hash"))
    return R.check_freshness(files(s, d).select("repo", "path", F.col("bytes").cast("string").alias("content_hash")), now)


def j5(s, d):
    dirs = files(s, d).select(F.explode(P.ancestors(F.col("path"))).alias("dir")).distinct()
    scored = dirs.crossJoin(F.broadcast(s.createDataFrame([(0,), (1,)], "query_id int"))).withColumn("score", ((F.length("dir") * 7 + F.col("query_id") * 3) % 10) / 10)
    return R.reachable_files(files(s, d).select("path"), scored)


def waves(s, d):
    """Documents as files some levels deep, for six questions; scores come from hashes, those of odd questions are none of them strong."""
    i = F.col("doc_id")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("m"), i % 11), F.concat(F.lit("n"), i % 3), F.concat(F.lit("doc"), i))
    own = table(s, d, "documents").select(path.alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    tree = T.tree_of(own.filter("path is not null").groupBy("path").agg(F.max("bytes").alias("bytes")).withColumn("cost", F.least(F.col("bytes"), F.lit(2000)) + 40))
    asked = tree.select("path", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("query_id"))
    drawn = F.conv(F.left(F.md5(F.concat_ws("/", "query_id", "path")), F.lit(6)), 16, 10).cast("long") % 1000 / 1000
    scored = asked.select("query_id", "path", F.when(F.col("query_id") % 2 == 1, 0.45 + drawn * 0.149).otherwise(drawn).alias("score"))
    seeds = s.range(6).select(F.col("id").cast("int").alias("query_id"), F.lit(".").alias("path"))
    found = T.traverse(tree, scored, asked.filter(F.crc32(F.concat_ws("/", "path", "query_id").cast("binary")) % 400 == 0), seeds, T.Limits(budget_bytes=150_000))
    return found.items.withColumn("score", F.round("score", 6))


def w2(s, d):
    batches = table(s, d, "events").select((F.col("user_id") % 40).alias("query_id"), F.col("event_id").alias("batch"), (F.col("value") * 100).cast("long").alias("bytes"))
    return R.navigation_budget(batches, 100_000)


def o8(s, d):
    best = scores(s, d).groupBy("query_id", "path").agg(F.max("score").alias("score"))
    return R.pick_probe(best, best.filter("score > 0.9").select("query_id", "path"))


def _tamed(s, d):
    """All scores; those of odd queries are none of them strong."""
    return scores(s, d).withColumn("score", F.when(F.col("query_id") % 2 == 1, F.col("score") * 0.599).otherwise(F.col("score")))


_BEST = f"{SCORES}, best AS (SELECT query_id, path, max(score) AS score FROM scores GROUP BY ALL)"

QUERIES = {
    "j1_check_freshness": (
        j1,
        f"""WITH {FILES} SELECT repo, path, CAST(bytes AS VARCHAR) AS content_hash, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS state FROM files""",
    ),
    "j2_lookup_answers": (lambda s, d: _answers(s, d)[0], f"WITH {_ANSWERS} SELECT event_id, digest, created_at FROM questions JOIN fresh USING (digest)"),
    "j2_unanswered": (lambda s, d: _answers(s, d)[1], f"WITH {_ANSWERS} SELECT event_id, digest FROM questions ANTI JOIN fresh USING (digest)"),
    "j3_pair_items": (
        lambda s, d: R.pair_items(_texts(s, d)[1].select("query_id"), _texts(s, d)[0].select("item_id"), R.lexical_scorer(*_texts(s, d)).filter("score > 0.5").select("query_id", "item_id")),
        f"WITH {_TOKENS}, n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1) SELECT query_id, item_id FROM i JOIN q USING (t) JOIN n USING (query_id) GROUP BY query_id, item_id, n HAVING count(*) / n > 0.5",
    ),
    "j4_token_matches": (lambda s, d: R.token_matches(*_texts(s, d)), f"WITH {_TOKENS} SELECT query_id, item_id, count(*) AS matched FROM i JOIN q USING (t) GROUP BY query_id, item_id"),
    "x1_lexical_scorer": (
        lambda s, d: R.score(*_texts(s, d)).withColumn("score", F.round("score", 9)),
        f"WITH {_TOKENS}, n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1) SELECT query_id, item_id, round(count(*) / any_value(n), 9) AS score FROM i JOIN q USING (t) JOIN n USING (query_id) GROUP BY query_id, item_id",
    ),
    "j5_reachable_files": (
        j5,
        f"""WITH {FILES}, q(query_id) AS (VALUES (0), (1)), p AS (SELECT path, string_split(path, '/') AS x FROM files),
        dirs AS (SELECT path, unnest(list_transform(range(2, len(x), 2), lambda i: array_to_string(x[1:i], '/'))) AS dir FROM p),
        bad AS (SELECT DISTINCT query_id, path FROM dirs, q WHERE ((length(dir) * 7 + query_id * 3) % 10) / 10 <= 0.5) SELECT query_id, path FROM files, q EXCEPT SELECT query_id, path FROM bad""",
    ),
    "j17_skip_seen": (
        lambda s, d: R.skip_seen(scores(s, d).select("query_id", "path").distinct(), scores(s, d).filter("score > 0.8"), ["query_id", "path"]),
        f"WITH {SCORES} SELECT DISTINCT query_id, path FROM scores EXCEPT SELECT query_id, path FROM scores WHERE score > 0.8",
    ),
    "a3_issue_counts": (
        lambda s, d: issue_counts(table(s, d, "events").select(F.col("event_type").alias("kind"))),
        "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1",
    ),
    "a5_best_chunk_score": (
        lambda s, d: R.best_chunk_score(scores(s, d)),
        f"WITH {_BEST} SELECT query_id, path, score, min(chunk) AS chunk FROM scores JOIN best USING (query_id, path, score) GROUP BY ALL",
    ),
    "a6_suppress_floods": (
        lambda s, d: R.suppress_floods(_tamed(s, d), 20).withColumn("score", F.round("score", 9)),
        f"""WITH {SCORES}, s AS (SELECT query_id, path, chunk, CASE WHEN query_id % 2 = 1 THEN score * 0.599 ELSE score END AS score FROM scores), f AS (SELECT query_id, count(*) FILTER (score > 0.5 AND score < 0.6) >= 20 AND NOT bool_or(score >= 0.6) AS flood FROM s GROUP BY 1)
        SELECT s.* REPLACE (round(score, 9) AS score) FROM s JOIN f USING (query_id) WHERE score > 0.5 AND (NOT flood OR score >= 0.6)""",
    ),
    "a8_distinct_requests": (
        lambda s, d: R.distinct_requests(table(s, d, "events").select(F.sha2("props", 256).alias("digest"), F.col("props").alias("question"))),
        "SELECT sha256(props) AS digest, min(props) AS question, count(*) AS asked FROM events GROUP BY 1",
    ),
    "f15_valid_answers": (
        f15,
        """WITH q AS (SELECT DISTINCT user_id % 50 AS digest, event_id % 20 AS question_id FROM events), a AS (SELECT user_id % 50 AS digest, event_id % 20 AS question_id, min(value) / 3 AS p FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
        SELECT digest, bool_and(coalesce(p BETWEEN 0 AND 1, false)) AS valid FROM q LEFT JOIN a USING (digest, question_id) GROUP BY digest""",
    ),
    "f18_admit": (
        lambda s, d: R.admit(scores(s, d)).groupBy("query_id", "relevant", "strong", "lead", "display").agg(F.count("*").alias("n")),
        f"WITH {SCORES} SELECT query_id, score > 0.5 AS relevant, score >= 0.6 AS strong, score > 0.25 AS lead, score > 0.7 AS display, count(*) AS n FROM scores GROUP BY ALL",
    ),
    "o7_admitted_files": (lambda s, d: R.admitted_files(scores(s, d)), f"WITH {SCORES} SELECT * FROM scores WHERE score > 0.5"),
    "o8_pick_probe": (
        o8,
        f"WITH {_BEST}, b AS (SELECT * FROM best WHERE score <= 0.9) SELECT query_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS n FROM b) WHERE n = 1",
    ),
    "u2_union_waves": (
        lambda s, d: R.union_waves(*[scores(s, d).filter(f"chunk {k}").select("query_id", "path") for k in ("= 1", "= 2", "> 2")]),
        f"WITH {SCORES} SELECT DISTINCT query_id, path FROM scores",
    ),
    # a state of budgets, probes and floods that the next wave depends on: held against a plain walk in the tests
    "w2_traverse_waves": (waves, None),
    "w2_navigation_budget": (
        w2,
        """SELECT query_id, batch, bytes, so_far, so_far <= 100000 AS within FROM (SELECT user_id % 40 AS query_id, event_id AS batch, CAST(trunc(value * 100) AS BIGINT) AS bytes,
        CAST(sum(CAST(trunc(value * 100) AS BIGINT)) OVER (PARTITION BY user_id % 40 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM events)""",
    ),
}
