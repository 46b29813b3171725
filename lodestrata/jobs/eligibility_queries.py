"""Queries on the eligibility of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import eligibility as E
from ..sources import files as R
from .mapping import FILES, files

_BASE = "regexp_extract(path, '[^/]*$')"
_DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"
_TOP = "CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END"
_EXT = f"regexp_extract({_BASE}, '^.+(\\.[^.]*)$', 1)"
_KIND = f"""CASE lower({_EXT}) WHEN '.py' THEN 'code' WHEN '.ts' THEN 'code' WHEN '.js' THEN 'code' WHEN '.go' THEN 'code' WHEN '.md' THEN 'docs' WHEN '.txt' THEN 'docs'
  WHEN '.json' THEN 'data' WHEN '.yaml' THEN 'config' WHEN '.log' THEN 'logs' WHEN '.mp3' THEN 'audio' WHEN '.zip' THEN 'archives' WHEN '.bak' THEN 'temp' ELSE 'unknown' END"""
_HIDDEN = "regexp_matches(path, '(^|/)\\.')"
_NAME = "(path LIKE '%/credentials.json' OR path LIKE '%.pem')"
_DEP = "regexp_matches(path, '(^|/)(node_modules|build)/')"
_VALUES = "regexp_extract_all(source, '(?i)(?:api[_-]?key|secret|token|password|passwd|credential)s?[\"'']?\\s*[:=]\\s*[\"'']([^\"''\\s]{16,})[\"'']', 1)"
_BITS = "list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -(len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v)) * log2(len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v))))"
_CONTENT = f"""(regexp_matches(source, '\\b(sk-[A-Za-z0-9_-]{{16,}}|gh[pousr]_[A-Za-z0-9]{{20,}}|glpat-[A-Za-z0-9_-]{{16,}}|npm_[A-Za-z0-9]{{20,}}|AKIA[0-9A-Z]{{16}}|xox[abprs]-[A-Za-z0-9-]{{10,}})')
  OR regexp_matches(source, 'https://hooks\\.slack\\.com/services/[A-Za-z0-9/]+')
  OR len(list_filter({_VALUES}, lambda v: NOT regexp_matches(v, '^[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}$')
     AND NOT regexp_matches(v, '(?i)(example|placeholder|changeme|your[_-]|xxxx|dummy|<|\\$\\{{)') AND {_BITS} >= 3.5)) > 0)"""
_KEY = "regexp_matches(source, '-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----')"
_DROP = "('audio', 'archives')"
_JUDGED = f"""{FILES}, judged AS (SELECT *, CASE WHEN {_HIDDEN} THEN 'hidden' WHEN {_NAME} THEN 'sensitive_name' WHEN {_DEP} THEN 'dependency'
  WHEN {_KIND} IN {_DROP} THEN 'file_type:' || {_KIND} WHEN {_KEY} THEN 'private_key' WHEN {_CONTENT} THEN 'sensitive_content' END AS reason FROM files)"""

POLICY = E.Policy(exclude_types=("audio", "archives"))


def judged(spark, sf_dir):
    return E.apply_policy(files(spark, sf_dir), POLICY)


def _paths(reason, value):
    def run(spark, sf_dir):
        return files(spark, sf_dir).withColumn("reason", reason()).filter("reason is not null").select("repo", "path", "reason")

    return run, f"WITH {FILES} SELECT repo, path, {value[1]} AS reason FROM files WHERE {value[0]}"


#: Rule files that lie beside the documents, and a nested repository.
RULE_FILES = (
    ("r0", ".gitignore", "# notes\n*.md  \n\nsrc1/\n"),
    ("r0", ".ignore", "!*.md\n"),
    ("r1", ".gitignore", "*.txt\r\n\\#kept\n"),
    ("r1", "src2/.gitignore", "!*.txt"),
    ("r2", "src3/.gitignore", "doc*.json\n!src3\n"),
    ("r2", ".gitignore", "**/*.ts\n"),
    ("r2", "src4/.git/HEAD", "ref"),
)


def corpus(spark, sf_dir):
    """The documents as files, with rule files among them."""
    own = spark.createDataFrame(RULE_FILES, "repo string, path string, source string").withColumn("bytes", F.octet_length("source").cast("long"))
    return files(spark, sf_dir).select("repo", "path", "bytes", "source").unionByName(own)


_IGNORED = """(repo = 'r1' AND path LIKE '%.txt' AND path NOT LIKE 'src2/%') OR (repo = 'r2' AND path LIKE '%.ts' AND path NOT LIKE 'src4/%')
  OR (repo = 'r2' AND path LIKE 'src3/%' AND regexp_matches(path, '/doc[^/]*\\.json$'))"""
WALK = E.Policy(exclude_types=("audio", "archives"), exclude=("src5/de/", "*.yaml"), protected=("src6",))


def _marked(spark, sf_dir, every, mark):
    """Files' bytes, with a mark after those of every so many documents."""
    data = F.col("source").cast("binary")
    return files(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % every == 0, F.concat(data, mark)).otherwise(data))


def excluded(spark, sf_dir):
    return E.excluded_counts(E.apply_policy(E.with_own_rules(corpus(spark, sf_dir)), WALK))


_TOPS = f"""{_JUDGED}, tops AS (SELECT DISTINCT repo, x[1] AS reason, x[2] AS top FROM (SELECT repo, CASE
  WHEN path LIKE 'src6/%' THEN ['protected', 'src6'] WHEN repo = 'r0' AND path LIKE 'src1/%' THEN ['ignored', 'src1'] WHEN path LIKE 'src5/de/%' THEN ['exclude_pattern', 'src5/de']
  WHEN {_HIDDEN} THEN ['hidden', regexp_extract(path, '^(.*?/)?\\.[^/]*')] WHEN path LIKE '%/credentials.json' OR path LIKE '%.pem' THEN ['sensitive_name', path]
  WHEN {_DEP} THEN ['dependency', regexp_extract(path, '^.*?/(node_modules|build)')] WHEN {_IGNORED} THEN ['ignored', path] WHEN path LIKE '%.yaml' THEN ['exclude_pattern', path]
  ELSE [reason, path] END AS x FROM judged) WHERE x[1] IS NOT NULL
  UNION ALL VALUES ('r0', 'hidden', '.gitignore'), ('r0', 'hidden', '.ignore'), ('r1', 'hidden', '.gitignore'), ('r1', 'hidden', 'src2/.gitignore'), ('r2', 'hidden', 'src3/.gitignore'), ('r2', 'hidden', '.gitignore'), ('r2', 'protected', 'src4/.git'))"""
_COUNTS = f"WITH {_TOPS} SELECT reason, count(*) AS n FROM tops GROUP BY reason"
_DIRS = f"WITH {_JUDGED}, dirs AS (SELECT {_TOP} AS dir, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM judged WHERE reason IS NULL GROUP BY 1)"
RULES = [("r0", ".", ".gitignore", 0, "*.md", False), ("r0", ".", ".gitignore", 1, "src1/", False), ("r0", ".", ".ignore", 0, "*.md", True), ("r1", ".", ".gitignore", 0, "*.txt", False), ("r1", "src2", ".gitignore", 0, "*.txt", True), ("r2", "src3", ".gitignore", 0, "doc*.json", False)]


def _rules(spark):
    rows = [(r, d, s, o, E.glob_regex(p), n, []) for r, d, s, o, p, n in RULES]
    return spark.createDataFrame(rows, "repo string, dir string, source string, ord int, regex string, negated boolean, stops array<string>")


def f5(spark, sf_dir):
    return E.with_own_rules(corpus(spark, sf_dir)).filter("ignored").select("repo", "path")


def f6(spark, sf_dir):
    dirs = files(spark, sf_dir).select("repo", P.dirname(F.col("path")).alias("dir")).distinct()
    scoped = E.scope_rules(_rules(spark).drop("stops"), dirs.filter("dir like 'src2/%'"))
    return scoped.select("repo", "dir", "source", "ord", F.array_join(F.array_sort("stops"), ",").alias("stops"))


QUERIES = {
    "a1_inventory_by_dir": (
        lambda s, d: E.inventory_by_dir(judged(s, d)),
        f"{_DIRS} SELECT dir, files, bytes FROM dirs UNION ALL SELECT NULL, CAST(sum(files) AS BIGINT), CAST(sum(bytes) AS BIGINT) FROM dirs",
    ),
    "a2_excluded_counts": (excluded, _COUNTS),
    "a4_extension_histogram": (
        lambda s, d: E.extension_histogram(files(s, d)).select("repo", "dir", F.to_json("extensions").alias("extensions")),
        f"""WITH {FILES}, c AS (SELECT repo, {_DIR} AS dir, {_EXT} AS ext, count(*) AS n FROM files GROUP BY ALL)
        SELECT repo, dir, '{{' || string_agg('"' || ext || '":' || n, ',' ORDER BY ext) || '}}' AS extensions FROM c GROUP BY repo, dir""",
    ),
    "a17_inventory_cube": (
        lambda s, d: E.inventory_cube(judged(s, d)),
        f"""WITH {_JUDGED} SELECT repo, kind, dir, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, grouping(repo) * 4 + grouping(kind) * 2 + grouping(dir) AS level
        FROM (SELECT repo, {_KIND} AS kind, {_TOP} AS dir, bytes FROM judged WHERE reason IS NULL) GROUP BY CUBE (repo, kind, dir)""",
    ),
    "f1_with_reason_protected": _paths(lambda: E.reason_protected(("src1/en",)), ("path LIKE 'src1/en/%'", "'protected'")),
    "f2_with_reason_hidden": _paths(E.reason_hidden, (_HIDDEN, "'hidden'")),
    "f3_with_reason_sensitive_name": _paths(E.reason_sensitive_name, (_NAME, "'sensitive_name'")),
    "f4_with_reason_dependency": _paths(E.reason_dependency, (_DEP, "'dependency'")),
    "f5_with_reason_ignored": (
        f5,
        f"WITH {FILES} SELECT repo, path FROM files WHERE (repo = 'r0' AND path LIKE 'src1/%') OR {_IGNORED}",
    ),
    "f6_scope_rules": (
        f6,
        f"""WITH {FILES}, b AS (SELECT DISTINCT repo, {_DIR} AS dir FROM files WHERE {_DIR} LIKE 'src2/%'),
        r(repo, dir, source, ord) AS (VALUES {', '.join(f"('{r}', '{d}', '{s}', {o})" for r, d, s, o, *_ in RULES)})
        SELECT r.repo, r.dir, r.source, r.ord, coalesce(string_agg(b.dir, ',' ORDER BY b.dir), '') AS stops FROM r
        LEFT JOIN b ON r.repo = b.repo AND r.source = '.gitignore' AND (r.dir = '.' OR starts_with(b.dir, r.dir || '/')) GROUP BY ALL""",
    ),
    "f7_with_reason_exclude": _paths(lambda: E.reason_exclude(("*.md", "src2/de/")), ("(path LIKE '%.md' OR path LIKE 'src2/de/%')", "'exclude_pattern'")),
    "f8_with_reason_file_type": _paths(lambda: E.reason_file_type(("code", "docs", "data"), ("data",)), (f"{_KIND} NOT IN ('code', 'docs')", f"'file_type:' || {_KIND}")),
    "f9_with_size_issue": (
        lambda s, d: files(s, d).withColumn("issue", E.size_issue(20_000, 8_000)).filter("issue is not null").select("repo", "path", "issue"),
        f"WITH {FILES} SELECT repo, path, CASE WHEN bytes > 20000 THEN 'resource_limit' ELSE 'not_inspected' END AS issue FROM files WHERE bytes > 8000",
    ),
    "f10_with_reason_binary": (
        lambda s, d: _marked(s, d, 11, F.lit(b"\x01")).select("repo", "path", E.reason_binary(F.col("content")).alias("reason")),
        f"WITH {FILES} SELECT repo, path, CASE WHEN regexp_matches(CASE WHEN doc_id % 11 = 0 THEN source || chr(1) ELSE source END, '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]') THEN 'binary' END AS reason FROM files",
    ),
    "f11_with_reason_invalid_utf8": (
        lambda s, d: _marked(s, d, 13, F.lit(b"\xc3")).select("repo", "path", E.reason_invalid_utf8(F.col("content")).alias("reason")),
        f"WITH {FILES} SELECT repo, path, CASE WHEN doc_id % 13 = 0 THEN 'invalid_utf8' END AS reason FROM files",
    ),
    "f12_with_reason_private_key": (
        lambda s, d: _marked(s, d, 17, F.lit(b"\n-----BEGIN EC PRIVATE KEY-----\n")).select("repo", "path", E.reason_private_key(F.col("content").cast("string")).alias("reason")).filter("reason is not null"),
        f"WITH {FILES} SELECT repo, path, 'private_key' AS reason FROM files WHERE doc_id % 17 = 0 OR {_KEY}",
    ),
    "f13_with_reason_sensitive_content": _paths(lambda: E.reason_sensitive_content(F.col("source")), (_CONTENT, "'sensitive_content'")),
    "f14_apply_policy": (
        lambda s, d: judged(s, d).groupBy("repo", "reason").agg(F.count("*").alias("n")),
        f"WITH {_JUDGED} SELECT repo, reason, count(*) AS n FROM judged GROUP BY ALL",
    ),
    "f17_opted_out": (
        lambda s, d: files(s, d).filter(E.opted_out(F.col("source"), "the the", 10)).select("repo", "path"),
        f"WITH {FILES} SELECT repo, path FROM files WHERE len(list_filter(string_split(source, chr(10))[1:10], lambda l: contains(l, 'the the'))) > 0",
    ),
    "o1_top_directories": (
        lambda s, d: E.top_directories(E.inventory_by_dir(judged(s, d)).filter("dir is not null"), 5),
        f"{_DIRS} SELECT *, greatest((SELECT count(*) FROM dirs) - 5, 0) AS more FROM (SELECT * FROM dirs ORDER BY bytes DESC, dir LIMIT 5)",
    ),
    "o2_list_paths": (lambda s, d: E.list_paths(judged(s, d)), f"WITH {_JUDGED} SELECT repo, path FROM judged WHERE reason IS NULL ORDER BY repo, path"),
    "o3_ordered_exclusions": (lambda s, d: E.ordered_exclusions(excluded(s, d)), f"{_COUNTS} ORDER BY n DESC, reason"),
    "o4_bound_entries": (
        lambda s, d: E.bound_entries(files(s, d).select("repo", "path"), 100),
        f"""WITH {FILES} SELECT repo, path, issue FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS n,
        CASE WHEN count(*) OVER (PARTITION BY repo) > 100 THEN 'resource_limit' END AS issue FROM files) WHERE n <= 100""",
    ),
    "o5_directory_preview": (
        lambda s, d: E.directory_preview(files(s, d), 4, 60).withColumn("names", F.array_join("names", "|")),
        f"""WITH {FILES}, w AS (SELECT repo, {_DIR} AS dir, {_BASE} AS name FROM files),
        r AS (SELECT *, row_number() OVER (PARTITION BY repo, dir ORDER BY name) AS n, sum(strlen(name)) OVER (PARTITION BY repo, dir ORDER BY name ROWS UNBOUNDED PRECEDING) AS b FROM w)
        SELECT repo, dir, coalesce(string_agg(name, '|' ORDER BY name) FILTER (n <= 4 AND b <= 60), '') AS names, bool_or(NOT (n <= 4 AND b <= 60)) AS truncated, count(*) AS entries FROM r GROUP BY repo, dir""",
    ),
    "p1_classify_file": (
        lambda s, d: files(s, d).groupBy(P.classify_file(F.col("path"), F.col("source")).alias("kind")).agg(F.count("*").alias("n")),
        f"WITH {FILES} SELECT {_KIND} AS kind, count(*) AS n FROM files GROUP BY 1",
    ),
    "p2_resolve_language": (
        lambda s, d: files(s, d).select("path", P.resolve_language(F.col("path"), F.col("source")).alias("language")).filter("language is not null"),
        f"WITH {FILES} SELECT path, CASE {_EXT} WHEN '.py' THEN 'python' WHEN '.ts' THEN 'TS' WHEN '.js' THEN 'JS' WHEN '.go' THEN 'go' END AS language FROM files WHERE {_EXT} IN ('.py', '.ts', '.js', '.go')",
    ),
    "p3_needs_shebang": (
        lambda s, d: files(s, d).filter(P.needs_shebang(F.col("path"))).select("path"),
        f"WITH {FILES} SELECT path FROM files WHERE {_EXT} = ''",
    ),
    "p4_path_parts": (
        lambda s, d: files(s, d).select("path", P.basename(F.col("path")).alias("base"), P.extname(F.col("path")).alias("ext"), P.dirname(F.col("path")).alias("dir"), P.top_dir(F.col("path")).alias("top")),
        f"WITH {FILES} SELECT path, {_BASE} AS base, {_EXT} AS ext, {_DIR} AS dir, {_TOP} AS top FROM files",
    ),
    "p5_ancestors": (
        lambda s, d: files(s, d).select("path", F.explode(P.ancestors(F.col("path"))).alias("dir")),
        f"WITH {FILES}, p AS (SELECT path, string_split(path, '/') AS x FROM files) SELECT path, array_to_string(x[1:i], '/') AS dir FROM (SELECT path, x, unnest(range(1, len(x))) AS i FROM p)",
    ),
    "s2_snapshot": (
        lambda s, d: R.snapshot(_marked(s, d, 13, F.lit(b"\xc3"))).select("repo", "path", F.length("source").alias("chars"), "content_hash"),
        f"""WITH {FILES} SELECT repo, path, CASE WHEN doc_id % 13 > 0 THEN length(source) END AS chars,
        CASE WHEN doc_id % 13 = 0 THEN sha256(encode(source) || '\\xC3'::BLOB) ELSE sha256(source) END AS content_hash FROM files""",
    ),
}
