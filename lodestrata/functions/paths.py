"""Path and file-type expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The category of each file extension.
EXTENSIONS = {
    "code": "c h cc hh cpp hpp cxx hxx cs fs fsx vb java kt kts scala clj cljs cljc edn groovy go rs py pyw pyi pyx rb php pl pm r jl lua sh bash zsh fish ps1 psm1 bat cmd js jsx mjs cjs ts tsx mts cts vue svelte astro html htm css scss sass less sql swift m mm dart ex exs erl hrl hs lhs ml mli elm f f90 f95 for pas asm s v vhd vhdl zig nim sol tf tfvars proto graphql gql cmake",
    "config": "yaml yml toml ini cfg conf config properties env editorconfig",
    "docs": "md mdx markdown rst txt adoc asciidoc tex org pod",
    "data": "json jsonl ndjson csv tsv xml arff parquet arrow feather avro orc h5 hdf5 hdf npy npz mat pkl pickle sqlite sqlite3 db sqlitedb ipynb geojson kml gpx pstats",
    "audio": "mp3 wav flac aac ogg oga opus m4a aiff aif wma mid midi",
    "video": "mp4 m4v mkv mov avi webm mpg mpeg m2ts vob flv wmv 3gp",
    "archives": "zip gz bz2 xz zst zstd tar tgz tbz tbz2 txz 7z rar jar war whl deb rpm iso dmg cab",
    "logs": "log out err trace",
    "temp": "tmp temp bak swp swo orig rej",
}
# File names with a category of their own.
CODE_NAMES = "makefile gnumakefile dockerfile containerfile rakefile gemfile justfile jenkinsfile vagrantfile build workspace cmakelists.txt"
CONFIG_NAMES = ".editorconfig .env .gitignore .ignore .gitattributes .dockerignore .npmrc .babelrc .eslintrc .prettierrc package.json package-lock.json yarn.lock bun.lock cargo.lock tsconfig.json jsconfig.json composer.json deno.json deno.jsonc"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extname(path: Column) -> Column:
    """With its dot; a name whose only dot is its first has none."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def dirname(path: Column) -> Column:
    """``.`` for a file at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def top_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def ancestors(path: Column) -> Column:
    """The directories above a path, from the top; none for a file at the root."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def interpreter(first_line: Column) -> Column:
    """The program that a shebang line runs; through ``env``, its first argument that is no option, operand or assignment."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(first_line, r"^#!", ""), r"\s+", " ")), " ")
    program = F.regexp_extract(F.element_at(words, 1), r"[^/]*$", 0)
    args = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    taken = F.filter(
        F.transform(args, lambda x, i: F.struct(x.alias("arg"), F.when(i > 0, F.get(args, i - 1)).alias("before"))),
        lambda p: ~p["arg"].startswith("-") & ~p["arg"].contains("=") & ~F.coalesce(p["before"].rlike("^-[uCPa]$"), F.lit(False)),
    )
    command = F.regexp_extract(F.coalesce(F.get(taken, F.lit(0))["arg"], F.lit("")), r"[^/]*$", 0)
    return F.when(program == "env", command).otherwise(program)


def resolve_language(path: Column, source: Column) -> Column:
    """By extension, else by the shebang of a file without one; null where neither tells. Programs, extensions and names here and below are fixed values."""
    program = interpreter(F.substring_index(F.coalesce(source, F.lit("")), "\n", 1))
    said = (
        F.when(program.rlike(r"^(python|pypy)(\d+(\.\d+)?)?$"), "python")
        .when(program.isin("node", "nodejs"), "JS")
        .when(program.isin("bun", "tsx", "deno"), "TS")
    )
    return (
        F.when(path.rlike(r"\.pyi?$"), "python")
        .when(path.endswith(".tsx"), "TSX")
        .when(path.endswith(".jsx"), "JSX")
        .when(path.rlike(r"\.[cm]?js$"), "JS")
        .when(path.rlike(r"\.[cm]?ts$"), "TS")
        .when(path.endswith(".go"), "go")
        .when(path.endswith(".rs"), "rust")
        .when((extname(path) == "") & F.coalesce(source, F.lit("")).startswith("#!"), said)
    )


def classify_file(path: Column, source: Column | None = None, extensions: dict[str, str] = EXTENSIONS) -> Column:
    """One of nine categories or ``unknown``: by name, then extension, then shebang. ``extensions`` maps a category to its extensions."""
    name = F.lower(basename(path))
    ext = extname(name)
    json_config = name.rlike(r"\.jsonc?$") & (
        name.startswith(".") | name.isin("biome.json", "biome.jsonc") | name.rlike(r"^(ts|js)config.*\.jsonc?$") | name.rlike(r"\.config\.jsonc?$")
    )
    kind = F.when(name.endswith("~") | name.rlike(r"^#.*#$"), "temp")
    kind = kind.when(name.rlike(r"\.log(\.\d+)?(\.(gz|bz2|xz|zst))?$"), "logs")
    kind = kind.when(name.isin(*CODE_NAMES.split()) | name.startswith("dockerfile."), "code")
    kind = kind.when(name.isin(*CONFIG_NAMES.split()) | name.startswith(".env.") | json_config, "config")
    for category, names in extensions.items():
        kind = kind.when(ext.isin(*(f".{x}" for x in names.split())), category)
    if source is not None:
        kind = kind.when(resolve_language(path, source).isNotNull(), "code")
    return kind.otherwise("unknown")


def needs_shebang(path: Column) -> Column:
    return (classify_file(path) == "unknown") & (extname(path) == "")
