"""Which files of a corpus are eligible, and why the others are not.

``files`` has ``repo, path, bytes`` and, for content checks, ``source`` (text) or ``content`` (binary).
Each predicate is a column with its reason or null; the first that fails wins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.paths import ancestors, basename, classify_file, dirname, top_dir
from ..functions.text import shannon_entropy
from .ignore_walk import walked

# Directories of dependencies, and names that hold credentials.
DEPENDENCY_DIRS = "node_modules vendor venv .venv .tox __pycache__ dist build coverage target .next .nuxt .turbo".split()
SENSITIVE_NAMES = "credentials credentials.json secrets.json secrets.yaml secrets.yml id_rsa id_dsa id_ecdsa id_ed25519 .netrc .npmrc .pypirc".split()
SENSITIVE_SUFFIXES = ".env .pem .key .p12 .pfx".split()
MAX_FILE_BYTES = 16 * 1024 * 1024
MAX_INSPECT_BYTES = 1_000_000

PRIVATE_KEY = r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"
TOKEN_PREFIX = r"\b(sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|xox[abprs]-[A-Za-z0-9-]{10,})"
SLACK_HOOK = r"https://hooks\.slack\.com/services/[A-Za-z0-9/]+"
ASSIGNMENT = r"""(?i)(?:api[_-]?key|secret|token|password|passwd|credential)s?["']?\s*[:=]\s*["']([^"'\s]{16,})["']"""
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
PLACEHOLDER = r"(?i)(example|placeholder|changeme|your[_-]|xxxx|dummy|<|\$\{)"


@dataclass(frozen=True)
class Policy:
    only: tuple[str, ...] | None = None
    exclude_types: tuple[str, ...] = ()
    hidden: bool = False
    no_ignore: bool = False
    include_dependencies: bool = False
    include_sensitive: bool = False
    protected: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


def _parts() -> Column:
    return F.split("path", "/")


def _first(named: Callable[[Column], Column]) -> Column:
    """Number of the first component that ``named`` holds for; null if there is none."""
    at = F.array_position(F.transform(_parts(), named), True)
    return F.when(at > 0, at.cast("int"))


def protected_at(prefixes=()) -> Column:
    """Each ``*_at`` is the number of the component, from 1, at which a walk from the root leaves a path out; null if it doesn't."""
    under = [F.when((F.col("path") == p) | F.col("path").startswith(f"{p}/"), F.lit(p.count("/") + 1)) for p in prefixes]
    return F.least(_first(lambda p: p == ".git"), *under) if under else _first(lambda p: p == ".git")


def hidden_at() -> Column:
    return _first(lambda p: p.startswith("."))


def sensitive_name_at() -> Column:
    def named(part: Column) -> Column:
        own = F.lower(part)
        hit = own.isin(*SENSITIVE_NAMES) | (own == ".env") | own.startswith(".env.")
        for suffix in SENSITIVE_SUFFIXES:
            hit = hit | own.endswith(suffix)
        return hit

    return _first(named)


def dependency_at() -> Column:
    """Directories only: a file of such a name stays."""
    at = _first(lambda p: p.isin(*DEPENDENCY_DIRS))
    return F.when(at < F.size(_parts()), at)


def exclude_at(patterns=()) -> Column:
    if not patterns:
        return F.lit(None).cast("int")
    n = F.size(_parts())
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(_parts(), F.lit(1), i), "/"), F.when(i < n, "/").otherwise("")))

    def fits(pattern: str) -> Callable[[Column], Column]:
        return lambda x: x.rlike("(?i)" + glob_regex(pattern))

    at = [F.array_position(F.transform(steps, fits(p)), True) for p in patterns]
    return F.least(*[F.when(x > 0, x.cast("int")) for x in at], F.lit(None).cast("int"))


def reason_protected(prefixes=()) -> Column:
    return F.when(protected_at(prefixes).isNotNull(), "protected")


def reason_hidden(hidden: bool = False) -> Column:
    return F.when(F.lit(not hidden) & F.exists(_parts(), lambda p: p.startswith(".")), "hidden")


def reason_sensitive_name(include_sensitive: bool = False) -> Column:
    return F.when(F.lit(not include_sensitive) & sensitive_name_at().isNotNull(), "sensitive_name")


def reason_dependency(include_dependencies: bool = False) -> Column:
    return F.when(F.lit(not include_dependencies) & dependency_at().isNotNull(), "dependency")


def glob_regex(pattern: str) -> str:
    """A root-relative glob as a regular expression over paths: without a slash it fits at any depth, with one at its end directories."""
    anchored = "/" in pattern.rstrip("/")
    body, i, p = "", 0, pattern.strip("/")
    while i < len(p):
        if p[i : i + 3] == "**/":
            body, i = body + "(?:.*/)?", i + 3
        elif p[i : i + 2] == "**":
            body, i = body + ".*", i + 2
        elif p[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif p[i] == "?":
            body, i = body + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            body, i = body + p[i : j + 1].replace("[!", "[^"), j + 1
        else:
            body, i = body + ("\\" + p[i] if p[i] in r"\.^$+{}()|]" else p[i]), i + 1
    return ("^" if anchored else "(?:^|.*/)") + body + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


def reason_exclude(patterns=()) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("path").rlike("(?i)" + glob_regex(p))
    return F.when(hit, "exclude_pattern")


def reason_file_type(only=None, exclude_types=()) -> Column:
    kind = classify_file(F.col("path"))
    out = kind.isin(*exclude_types) if exclude_types else F.lit(False)
    if only is not None:
        out = out | ~kind.isin(*only)
    return F.when(out, F.concat(F.lit("file_type:"), kind))


def size_issue(max_file_bytes: int = MAX_FILE_BYTES, max_inspect_bytes: int = MAX_INSPECT_BYTES) -> Column:
    return F.when(F.col("bytes") > max_file_bytes, "resource_limit").when(F.col("bytes") > max_inspect_bytes, "not_inspected")


def reason_binary(content: Column) -> Column:
    return F.when(F.decode(content, "ISO-8859-1").rlike(r"[\x00-\x08\x0b\x0e-\x1f\x7f]"), "binary")


def reason_invalid_utf8(content: Column) -> Column:
    return F.when(~F.is_valid_utf8(content.cast("string")), "invalid_utf8")


def reason_private_key(source: Column, include_sensitive: bool = False) -> Column:
    return F.when(F.lit(not include_sensitive) & source.rlike(PRIVATE_KEY), "private_key")


def reason_sensitive_content(source: Column, include_sensitive: bool = False, least_bits: float = 3.5) -> Column:
    """Token prefixes and hook addresses, and assignments of values of 16 characters or more and enough entropy."""
    values = F.when(source.rlike(ASSIGNMENT), F.regexp_extract_all(source, F.lit(ASSIGNMENT), F.lit(1)))
    shaped = F.exists(values, lambda v: ~v.rlike(UUID) & ~v.rlike(PLACEHOLDER) & (shannon_entropy(v) >= least_bits))
    hit = source.rlike(TOKEN_PREFIX) | source.rlike(SLACK_HOOK) | F.coalesce(shaped, F.lit(False))
    return F.when(F.lit(not include_sensitive) & hit, "sensitive_content")


def opted_out(source: Column, pragma: str, lines: int = 10) -> Column:
    return F.exists(F.slice(F.split(source, "\n"), 1, lines), lambda line: line.contains(pragma))


IGNORE_FILES = (".gitignore", ".ignore")


def ignore_rules(files: DataFrame) -> DataFrame:
    """``(repo, dir, source, ord, regex, negated)``: the rules of the corpus' own ``.gitignore`` and ``.ignore`` files, from ``files(repo, path, source)``.

    A line is a rule unless it is blank or begins with ``#``. ``!`` takes back what rules before it ignored; a backslash before ``#``, ``!`` or a
    space at the end makes that an ordinary character, other spaces at the end and a carriage return don't count. Null sources have no rules.
    """
    own = files.select("repo", dirname(F.col("path")).alias("dir"), basename(F.col("path")).alias("source"), F.col("source").alias("_text")).filter(F.col("source").isin(*IGNORE_FILES))
    lines = own.select("repo", "dir", "source", F.posexplode(F.split("_text", "\n")).alias("ord", "line"))
    trimmed = F.regexp_replace(F.regexp_replace("line", r"\r$", ""), r"(?<!\\) +$", "")
    rules = lines.select("repo", "dir", "source", "ord", trimmed.alias("line")).filter(~F.col("line").rlike(r"^(?:#|!?/*$)"))
    negated = F.col("line").startswith("!")
    pattern = F.regexp_replace(F.when(negated, F.substr("line", F.lit(2))).otherwise(F.col("line")), r"\\([#! ])", "$1")

    @F.pandas_udf("string")
    def regex(patterns: pd.Series) -> pd.Series:
        return patterns.map(glob_regex)

    return rules.select("repo", "dir", "source", "ord", regex(pattern).alias("regex"), negated.alias("negated"))


def nested_repositories(files: DataFrame) -> DataFrame:
    """``(repo, dir)``: directories that hold a ``.git``, the root left out."""
    inner = F.regexp_extract("path", r"^(.+?)/\.git(?:/|$)", 1)
    return files.select("repo", inner.alias("dir")).filter("dir <> ''").distinct()


def scope_rules(rules: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Rules with the directory they reach down to: a ``.gitignore`` above a nested repository does not reach into it.

    ``rules(repo, dir, source, ord, regex, negated)``, ``boundaries(repo, dir)``; adds ``stops``, the nested repositories.
    """
    # a boundary meets the rules of the directories above it by name
    above = F.concat(F.array(F.lit(".")), ancestors(F.col("dir")))
    inner = boundaries.select("repo", F.col("dir").alias("_d"), F.explode(above).alias("dir"))
    stops = inner.join(rules.filter("source = '.gitignore'").select("repo", "dir").distinct(), ["repo", "dir"]).groupBy("repo", "dir").agg(F.collect_set("_d").alias("stops"))
    joined = rules.join(stops.withColumn("source", F.lit(".gitignore")), ["repo", "dir", "source"], "left")
    return joined.select(*rules.columns, F.coalesce("stops", F.array().cast("array<string>")).alias("stops"))


def reason_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``ignored`` and ``ignored_at`` to files by gitignore-like rules with ``stops`` (see :func:`scope_rules`).

    Each component from the top is judged by the last rule that fits among the scopes above it; the first
    excluded one ends the walk, so that nothing below it comes back (see :func:`ignore_walk.walked`).
    """
    return walked(files, rules).withColumn("ignored", F.col("ignored_at").isNotNull())


def with_own_rules(files: DataFrame) -> DataFrame:
    """Adds ``ignored`` and ``ignored_at`` by the rule files that ``files(repo, path, source)`` hold, within the nested repositories they hold."""
    return reason_ignored(files, scope_rules(ignore_rules(files), nested_repositories(files)))


def apply_policy(files: DataFrame, policy: Policy = Policy(), content: bool = True) -> DataFrame:
    """Adds ``reason``, null for an eligible file, and ``top``, the path down to the component that was left out.

    A walk from the root leaves out a directory with all below it, so the first component with a reason decides, and
    of its reasons the first in order; then come the file's own reasons. ``ignored_at``, if there (see :func:`with_own_rules`), is heeded unless the policy lifts it.
    """
    walk = [("protected", protected_at(policy.protected))]
    if not policy.hidden:
        walk.append(("hidden", hidden_at()))
    if not policy.include_sensitive:
        walk.append(("sensitive_name", sensitive_name_at()))
    if not policy.include_dependencies:
        walk.append(("dependency", dependency_at()))
    if "ignored_at" in files.columns and not policy.no_ignore:
        walk.append(("ignored", F.col("ignored_at")))
    walk.append(("exclude_pattern", exclude_at(policy.exclude)))
    steps = [F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(i).alias("i"), F.lit(reason).alias("reason"))) for i, (reason, at) in enumerate(walk)]
    own = [reason_file_type(policy.only, policy.exclude_types)]
    if "content" in files.columns:
        own += [reason_binary(F.col("content")), reason_invalid_utf8(F.col("content"))]
    if content:
        own += [reason_private_key(F.col("source"), policy.include_sensitive), reason_sensitive_content(F.col("source"), policy.include_sensitive)]
    judged = files.withColumn("_walk", F.least(*steps))
    reason = F.coalesce(F.col("_walk.reason"), *own)
    return judged.withColumns({"reason": reason, "top": F.coalesce(F.array_join(F.slice(_parts(), F.lit(1), F.col("_walk.at")), "/"), F.col("path"))}).drop("_walk")


def inventory_by_dir(judged: DataFrame) -> DataFrame:
    """Eligible files and bytes by top directory, with one row (``dir`` null) for all."""
    kept = judged.filter("reason is null").select(top_dir(F.col("path")).alias("dir"), "bytes")
    return kept.rollup("dir").agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def excluded_counts(judged: DataFrame) -> DataFrame:
    """Excluded paths by reason; what lies below an excluded directory counts once, as that directory, whatever the reason."""
    return judged.filter("reason is not null").select("repo", "top", "reason").distinct().groupBy("reason").agg(F.count("*").alias("n"))


def ordered_exclusions(excluded: DataFrame) -> DataFrame:
    return excluded.orderBy(F.desc("n"), "reason")


def top_directories(dirs: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest by bytes, and ``more``, the number of others."""
    total = dirs.agg(F.count("*").alias("_all"))
    first = dirs.orderBy(F.desc("bytes"), "dir").limit(n)
    return first.crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.col("_all") - n, F.lit(0))).drop("_all")


def list_paths(judged: DataFrame) -> DataFrame:
    return judged.filter("reason is null").select("repo", "path").orderBy("repo", "path")


def inventory_cube(judged: DataFrame, dims=("repo", "kind", "dir")) -> DataFrame:
    kept = judged.filter("reason is null").select("repo", classify_file(F.col("path")).alias("kind"), top_dir(F.col("path")).alias("dir"), "bytes")
    return kept.cube(*dims).agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"), F.grouping_id().cast("long").alias("level"))


def extension_histogram(files: DataFrame) -> DataFrame:
    """By directory, a map from extension to files."""
    from ..functions.paths import extname

    counts = files.groupBy("repo", dirname(F.col("path")).alias("dir"), extname(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))
    return counts.groupBy("repo", "dir").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("extensions"))


def bound_entries(entries: DataFrame, max_entries: int = 100_000) -> DataFrame:
    """The first entries of each repository by path; ``issue`` on all where some were left out.

    Each task passes on its own first entries only, so a large repository costs ``max_entries`` rows a task.
    """
    n = entries.groupBy("repo").agg(F.count("*").alias("_all"))
    # a limit on the rank alone: tasks keep their first entries before the exchange
    first = entries.withColumn("_n", F.row_number().over(W.partitionBy("repo").orderBy("path"))).filter(F.col("_n") <= max_entries)
    joined = first.withColumnRenamed("repo", "_repo").join(n, F.col("_repo").eqNullSafe(F.col("repo"))).drop("_repo")
    return joined.withColumn("issue", F.when(F.col("_all") > max_entries, "resource_limit")).select(*entries.columns, "issue")


def directory_preview(entries: DataFrame, max_items: int = 64, max_bytes: int = 4096) -> DataFrame:
    """The first names of each directory within both bounds; ``truncated`` tells whether some were left out."""
    w = W.partitionBy("repo", "dir").orderBy("name")
    own = entries.select("repo", dirname(F.col("path")).alias("dir"), basename(F.col("path")).alias("name"))
    ranked = own.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.sum(F.octet_length("name")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    fits = (F.col("_n") <= max_items) & (F.col("_b") <= max_bytes)
    return ranked.groupBy("repo", "dir").agg(
        F.array_sort(F.collect_list(F.when(fits, F.col("name")))).alias("names"), F.bool_or(~fits).alias("truncated"), F.count("*").alias("entries")
    )
