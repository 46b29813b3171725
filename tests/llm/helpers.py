"""Small corpora with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

#: Extra columns whose names the operators use themselves.
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("component", T.StringType()),
        T.StructField("h", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("z", T.StringType()),
        T.StructField("sequence_id", T.StringType()),
    ]
)


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" + rng.choice(["", "", "", ".", "é"]) for _ in range(n)]


def corpus(seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    base = [words(rng, n, 100_000) for n in (120, 300, 40, 800)]
    passage = " ".join(words(rng, 90, 100_000))
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two", "One TWO", "a" * 3000, "ab " * 900]
    for b in base:
        texts += [" ".join(b)] * 3
        for k in (1, 2, 5, 12):
            c = list(b)
            for _ in range(k):
                c[rng.randrange(len(c))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(c))
    texts += [" ".join(words(rng, 60)) + " " + passage + " " + " ".join(words(rng, 60)) for _ in range(5)]
    texts += ["\n".join(" ".join(words(rng, 8)) + "." for _ in range(12)) for _ in range(5)]
    shared = "\n".join(" ".join(words(rng, 9, 10**6)) + "." for _ in range(10)) + "\n"
    texts += ["\n".join(" ".join(words(rng, 8)) + "." for _ in range(4)) + "\n" + shared + " ".join(words(rng, 9)) for _ in range(4)]
    texts.append(" ".join(words(rng, 60_000)))  # very long
    return [(i, t, rng.choice(["en", None]), rng.choice(["s0", "s1", None]), len(t or ""), "c", "h", "k", "z", "s") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def split_lines(text: str) -> list[str]:
    """Lines end after a line feed and after a sentence's end with a space."""
    return [x for x in re.split(r"(?<=\n)|(?<=[.!?] )", text) if x]


def check_line_dedup(before: dict[int, str], after: dict[int, str], least_lines: int = 2, least_words: int = 20, sure: int = 4) -> int:
    """Plain rules for a corpus without repeated lines: what went stands earlier, what is left has no long run that stands earlier.

    Returns the number of lines that went.
    """
    lines = {i: split_lines(t or "") for i, t in before.items()}
    order = sorted(before)
    gone: dict[int, list[bool]] = {}
    for i in order:
        # which lines are left: whole lines go, so the rest is a subsequence; equal lines are told apart by runs
        rest, own = after[i], []
        for line in lines[i]:
            stays = rest.startswith(line)
            own.append(not stays)
            rest = rest[len(line) :] if stays else rest
        assert rest == "", i
        gone[i] = own
    earlier: dict[tuple, list] = {}
    for i in order:
        for k in range(len(lines[i]) - least_lines + 1):
            earlier.setdefault(tuple(lines[i][k : k + least_lines]), []).append((i, k))
    for i in order:
        own, n = lines[i], len(lines[i])
        k = 0
        while k < n:
            if not gone[i][k]:
                k += 1
                continue
            e = k
            while e < n and gone[i][e]:
                # each line that went is one of a pair that stands earlier
                pairs = [own[x : x + least_lines] for x in range(max(k, e - least_lines + 1), e + 1)]
                assert any(min(earlier.get(tuple(p), [(i, e)])) < (i, x) for p, x in zip(pairs, range(max(k, e - least_lines + 1), e + 1))), (i, e)
                e += 1
            assert e - k >= least_lines and len("".join(own[k:e]).split()) >= least_words, (i, k, e)
            k = e
        # a run whose pairs all stand first in one earlier place has gone
        x = 0
        while x + sure <= n:
            firsts = [min(earlier[tuple(own[y : y + least_lines])]) for y in range(x, n - least_lines + 1)]
            m = 0
            while m < len(firsts) and firsts[m] < (i, x + m) and firsts[m] == (firsts[0][0], firsts[0][1] + m):
                m += 1
            run = own[x : x + m + least_lines - 1]
            if m and len(run) >= sure and len("".join(run).split()) >= least_words:
                assert all(gone[i][x : x + len(run)]), (i, x, len(run))
                x += len(run)
            else:
                x += 1
    return sum(sum(g) for g in gone.values())
