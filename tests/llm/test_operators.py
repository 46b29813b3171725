"""Each operator against a brute-force version over awkward rows, and over empty tables."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pytest

from lodestrata.llm import decontaminate, extract, jaccard, line_dedup, media, packing, quality, rollups, substrings, url_filter
from lodestrata.llm.components import connected_components

from .helpers import DOCS, check_line_dedup, corpus, frame

ROWS = corpus()
TEXT = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, 5), (None, 3), (1000, 1001), (1001, 1000)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("hot,part_bytes", [(substrings.HOT, substrings.PART_BYTES), (2, 1500)])
def test_substrings(docs, none, hot, part_bytes, monkeypatch):
    own = substrings.repeated_starts
    monkeypatch.setattr(substrings, "repeated_starts", lambda docs, length: own(docs, length, hot=hot, part_bytes=part_bytes))
    n = collections.Counter()
    data = {i: t.encode() for i, t in TEXT.items()}
    for b in data.values():
        n.update(b[k : k + 400] for k in range(len(b) - 399))
    for r in substrings.remove_repeats(docs).collect():
        b = data[r.doc_id]
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 399):
            if n[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(b), int(gone.sum()), runs, kept), r.doc_id
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_with_equal_sides(spark):
    """Strings that only differ in how many of the same bytes stand before and after a core aren't equal."""
    rng = random.Random(19)
    core = "".join(rng.choice("abcdefghijklmnop") for _ in range(369))
    rows = [(k, "-" * k + core + "-" * (31 - k)) for k in range(32)] + [(100, "x" + "-" * 9 + core + "-" * 22 + "y")]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 400 if k in (9, 100) else 0 for k, _ in rows}


@pytest.mark.parametrize("length", [8, 9, 15, 16, 31, 64, 100, 369, 400])
def test_refined_buckets(length):
    """Equal identifiers, equal bytes."""
    rng = random.Random(length)
    data = bytes(rng.choice(b"ab") for _ in range(900)) + b"a" * 500
    data += data[:700]
    ids = substrings.refined(substrings._words(data), 8, length)
    assert len(ids) == len(data) - length + 1
    by_id, by_bytes = collections.defaultdict(set), collections.defaultdict(set)
    for k, x in enumerate(ids.tolist()):
        by_id[x].add(k)
        by_bytes[data[k : k + length]].add(k)
    assert sorted(map(sorted, by_id.values())) == sorted(map(sorted, by_bytes.values()))


def test_strings_of_many_contexts(spark):
    """One passage in different places of many documents, which meet in no whole range."""
    rng = random.Random(21)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(450))
    rows = [(k, "".join(rng.choice("qrstuvwxyz ") for _ in range(rng.randrange(1, 300))) + "." + passage + "." + "".join(rng.choice("qrstuvwxyz ") for _ in range(rng.randrange(1, 300)))) for k in range(60)]
    rows += [(100, passage[:420]), (101, passage[:399])]
    n = collections.Counter(t[x : x + 400] for _, t in rows for x in range(len(t) - 399))
    want = {k: own for k, t in rows if (own := {x for x in range(len(t) - 399) if n[t[x : x + 400]] > 1})}
    assert len(want) == 61
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2000, 7):
        got = substrings.repeated_starts(df, hot=hot).collect()
        starts = {r.doc_id: {x for s in r.spans for x in range(s.a, s.b + 1)} for r in got}
        assert starts == want


def test_substring_parts():
    rng = random.Random(2)
    data = bytes(rng.randrange(97, 101) for _ in range(30_000))
    seen = set()
    for offset, part in substrings._parts(data, 400, 5000):
        *_, first, last = substrings.suffix_ranges(part)
        seen.update(x + offset for a, b in zip(first, last) for x in range(a, b + 1))
    assert seen == set(range(len(data) - 399))


def _jaccard(rows, n, num, den):
    sets = {}
    for i, t in rows.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {(i, len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard(docs, n, num, den):
    want = _jaccard(TEXT, n, num, den)
    for complete in (True, False):
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, n, num, den, complete).collect()} == want


def test_jaccard_blocks(spark, monkeypatch):
    """Components of several blocks, with documents that only link to members beyond the hub."""
    monkeypatch.setattr(jaccard, "BLOCK_FEATURES", 600)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(100)]
    rows, text = {}, list(base)
    for i in range(40):  # a chain: each is near the one before
        rows[i] = " ".join(text)
        text[rng.randrange(100)] = f"x{i}"
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    sizes = df.select("doc_id").withColumn("component", df["doc_id"] * 0)
    full = jaccard.set_sizes(df, 3).join(sizes, "doc_id").select("doc_id", "component", "n_shingles")
    links = jaccard.verified_edges(df, full, 3, 90, 100, block_features=600)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = {i: c for i, _, c in _jaccard(rows, 3, 90, 100)}
    assert {i: got.get(i, i) for i in rows} == want


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100)])
@pytest.mark.parametrize("size", [320, 700, 2500])
def test_recall_of_signatures(num, den, size):
    """Pairs of large sets at the very threshold, which differ in as many features as they may."""
    rng = np.random.default_rng(size)
    missed = {True: 0, False: 0}
    for _ in range(120):
        both = rng.integers(1, 2**63, size * num // den, dtype=np.uint64)
        apart = rng.integers(1, 2**63, len(both) * den // num - len(both), dtype=np.uint64)
        cut = rng.integers(0, len(apart) + 1)
        a, b = (np.unique(np.concatenate([both, x])) for x in (apart[:cut], apart[cut:]))
        assert den * len(both) >= num * (len(both) + len(apart))
        for complete in missed:
            missed[complete] += not np.intersect1d(jaccard.signatures(a, num, den, complete), jaccard.signatures(b, num, den, complete)).size
    assert missed == {True: 0, False: 0}


def test_jaccard_empty(none):
    assert jaccard.jaccard_components(none).count() == 0


def test_lines(docs, none):
    kept = {r.doc_id: (r.kept, r.n_bytes_removed, r.n_regions) for r in line_dedup.dedup_lines(docs).collect()}
    assert sum(n for *_, n in kept.values()) >= 3
    check_line_dedup(TEXT, {i: k for i, (k, *_) in kept.items()})
    assert all(len(TEXT[i].encode()) - len(k.encode()) == n for i, (k, n, _) in kept.items())
    assert line_dedup.dedup_lines(none).count() == 0


def test_decontamination(spark, docs, none):
    rng = random.Random(6)
    items = [(k, "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(90, 300))).strip()) for k in range(6)] + [(6, None), (7, ""), (8, "short")]
    rows, want = [], set()
    for i in range(30):
        k = i % 6
        t = list(items[k][1])
        for _ in range(i * 7 % 31):
            at = rng.randrange(1, len(t) - 1)
            t[at : at + 1] = rng.choice([[], ["z"], [t[at], "y"]])
        text = "q" * 40 + " " + "".join(t) + " " + "r" * 50
        a, b = decontaminate.normalized(items[k][1].encode()), decontaminate.normalized(text.encode())
        prev = [0] * (len(b) + 1)
        for x, ca in enumerate(a):
            cur = [x + 1]
            for y, cb in enumerate(b):
                cur.append(min(prev[y] + (ca != cb), prev[y + 1] + 1, cur[y] + 1))
            prev = cur
        if min(prev) <= min(int(len(a) * decontaminate.EDIT_SHARE), (len(a) - decontaminate.Q) // decontaminate.Q):
            want.add((1000 + i, k, min(prev)))
        rows.append((1000 + i, text))
    rows += [(2000, None), (2001, ""), (2002, "nothing to see here " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 300):  # in one block and in several
        got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(df, bench, block_bytes=block).collect()}
        assert got == want
    assert 10 < len(want) < 30
    assert decontaminate.find_leaks(docs, bench).count() == 0
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(df, bench).count() == len(rows) - len(want)


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == TEXT.keys()
    for i, own in by_doc.items():
        ids = np.array([*reference.encode(TEXT[i], add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024)))
        assert all(r.length == 1024 for r in own[1:]) and own[0].start == 0
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(none).count() == 0


def test_packing_plan():
    rng = random.Random(7)
    histogram = collections.Counter(min(1024, 1 + int(rng.expovariate(1 / 300))) for _ in range(20_000))
    runs = packing.plan_packing(histogram)
    used = collections.Counter()
    for pattern, n in runs:
        assert sum(pattern) <= 1024
        for length in pattern:
            used[length] += n
    assert used == histogram
    assert sum(n for _, n in runs) <= 1.01 * sum(k * v for k, v in histogram.items()) / 1024 + 1


def test_tokenizer_agrees():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.encoder(packing.vocabulary_path())
    for t in ["", " ", "  a  b\n\n c", "<|endoftext|>", "é¡ x", "don't 123 ½ ²", "\t\r\n", "日本語 text", "a" * 500, " x"]:
        assert own.encode_to_numpy(t, allowed_special="all").tolist() == reference.encode(t, add_special_tokens=False).ids


def test_media(docs, none):
    stored = media.fingerprints(media.to_wav(docs)).collect()
    assert len(stored) == len(ROWS)
    for r in stored:
        data = TEXT[r.doc_id].encode()
        payload = bytes(r.payload)
        assert r.n_bytes == len(data) and payload[: len(data)] == data and set(payload[len(data) :]) <= {255}
        assert len(payload) % 576 == 0 and len(payload) - len(data) <= 576 and media.decode_wav(bytes(r.media)) == payload
        assert r.times == sorted(r.times) and len(r.times) == len(r.codes)
    by_text = collections.defaultdict(set)
    for r in stored:
        by_text[TEXT[r.doc_id]].add((tuple(r.times), tuple(r.codes)))
    assert all(len(x) == 1 for x in by_text.values())
    assert media.fingerprints(media.to_wav(none)).count() == 0


def test_tone_peaks():
    t = np.arange(5760)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / 576)).astype(np.uint8)
    peaks = media.spectral_peaks(tone)
    assert (peaks[:, 0] == 20).all()
    times, codes = media.peak_pairs(peaks[:, :1])
    assert {c >> 16 for c in codes} == {20} and {c & 15 for c in codes} == {1, 2, 3}


def test_urls(spark):
    pages = [
        (1, "http://www.a.EXAMPLE.net/en/1?x=1"),
        (2, "https://a.example.net/de/2"),
        (3, "https://b.org/fr/3"),
        (4, "https://b.org/en/3"),
        (5, "https://alias.org/en/5"),
        (6, "https://far.org/en/6"),
        (7, None),
        (8, "no scheme"),
        (9, "https://x.example.com/de/1#z"),
        (10, "https://notexample.com/de/1"),
        (11, "https://mixed.org/en/1"),
        (12, "https://a.example.net"),
    ]
    edges = [("https://alias.org/en/5", "https://a.example.net/de/2"), ("https://far.org/en/6", "https://mid.org/x"), ("https://mid.org/x", "https://alias.org/en/5"), ("https://mixed.org/en/1", "https://x.example.com/de/1#z"), ("https://mixed.org/en/1", "https://b.org/fr/3")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, node string, spread string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.via) for r in url_filter.propagate(df, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got[1] == ("www.a.example.net", "/en/1", "example.net/en/", "allow", "rule")
    assert got[2][2:] == ("net/", "block", "rule")
    assert got[3][2:] == ("org/fr/", "allow", "rule")
    assert got[4][2:] == (None, "allow", "default")
    assert got[5][2:] == (None, "block", "alias") and got[6][2:] == (None, "block", "alias")
    assert got[7] == got[8] == ("", "", None, "allow", "default")
    assert got[9][2:] == ("example.com/de/", "block", "rule")
    assert got[10][2] is None
    assert got[11][2:] == (None, "allow", "alias")
    assert got[12] == ("a.example.net", "", None, "allow", "default")
    assert url_filter.propagate(df.limit(0), url_filter.declared_edges(df.limit(0).selectExpr("*", "url as html"))).count() == 0
    # repeated rows and null ids are judged alike; declared links join their pages
    html = '<link rel="canonical" href="https://x.example.com/de/1"><meta http-equiv=refresh content="0; url=https://other.org/en/2">'
    rows = [(None, "https://plain.org/en/1", html), (None, "https://plain.org/en/1", html), (20, "https://other.org/en/2", None), (21, "https://third.org/en/3", ""), (21, "https://third.org/en/3", ""), (None, None, html)]
    own = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), str(r.url), r.verdict, r.via) for r in url_filter.propagate(own, url_filter.declared_edges(own)).collect())
    want = [(None, "https://plain.org/en/1", "block", "alias")] * 2 + [(20, "https://other.org/en/2", "block", "alias")] + [(21, "https://third.org/en/3", "allow", "default")] * 2 + [(None, None, "allow", "default")]
    assert got == sorted((str(a), str(b), *rest) for a, b, *rest in want)


@pytest.mark.parametrize("k", [1, 7, 40, 99, 100, 500])
def test_top_k(spark, k):
    rng = random.Random(9)
    rows = [(i, rng.choice([rng.gauss(0, 5), 1.5, -3.0])) for i in range(100)]
    got = {r.doc_id for r in quality.top_k(spark.createDataFrame(rows, "doc_id long, key double"), "key", k).collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post"><h1>Head &amp; line</h1><p><b>First  para
graph</b><br><p>Second &eacute; one.</p><div class="ad">Buy!</div><form><label>Mail</label><input name=x></form><p>Third</p>
<section id="comments"><p>Reader says hi</p></section></article><aside>Side</aside><footer>&copy; foot</footer></body></html>"""


def test_extract(spark):
    pages = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "<p>" + "plain words without an article " * 5 + "<p>more " * 3), (5, "u", "no markup at all, but enough characters to be the main text of the page, as it is one long line"), (6, "u", "<article>Short")]
    df = spark.createDataFrame([(*p, "old") for p in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract.extract_text(df).collect()}
    assert got[1] == "Head & line\nFirst para graph\nSecond é one.\nThird"
    assert got[2] == got[3] == "" and got[6] == "Short"
    assert got[4].startswith("plain words") and got[5].startswith("no markup")
    assert extract.extract_text(df.limit(0)).count() == 0


def test_extract_unclosed():
    assert extract.main_text("<article><p>a &am b<p>c</article><div>after") == "a &am b\nc"
    assert extract.main_text("<main><ul><li>x<li>y</ul></main><nav>n") == "x\ny"
    assert extract.main_text("<article><p>x<!-- c --><script>if (a < b) {}</script> y</p><nav>menu</nav></article>") == "x\ny"




def test_null_and_repeated_ids(spark, docs):
    long = " ".join(f"v{k}" for k in range(200))
    odd = [(None, long, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    twice = [r for r in ROWS if r[0] in (5, 8, 12)]
    df = docs.unionByName(frame(spark, odd + twice))
    n = len(ROWS) + len(odd) + len(twice)
    base = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    got = jaccard.jaccard_components(df).collect()
    assert len(got) == n and all(r.component_id == base.get(r.doc_id) for r in got)
    lines = line_dedup.dedup_lines(df).collect()
    assert len(lines) == n and [r.kept for r in lines if r.doc_id is None and r.kept] == [long]
    removed = substrings.remove_repeats(df).collect()
    assert len(removed) == n and {bytes(r.kept) for r in removed if r.doc_id is None} == {b"", long.encode()}
    assert media.to_wav(df).count() == n
    packed = packing.pack_documents(df)
    assert packed.filter("piece = 0").count() == n and packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").count() == 0
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.find_leaks(df, bench).collect()] == [None]
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.resample(df, labels).count() == n
    assert rollups.signed(inserts=rollups.count_tokens(df)).agg({"n_docs": "sum"}).first()[0] == 2 * n
