"""Main text of web pages by the distribution of text over blocks of lines."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Lines whose lengths are summed, and the least peak of a region without a sentence as a share of the page's largest sum.
WINDOW = 3
SURGE_SHARE = 0.2
LINK_SHARE = 0.5

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What ends a tag, or begins a quoted value in it.
IN_TAG = re.compile(r"""=[ \t\n\r\f]*+(["'])|>""")
SPACE = re.compile(r"[ \t\n\r\f\v ]+")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+""")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)
#: Content that is never text of the page.
RAW = frozenset("script style noscript template iframe object svg canvas math textarea title xmp".split())
ASIDE = frozenset("nav header footer aside form button select option dialog menu head fieldset label datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark what stands beside the article, and those of readers' comments.
NOISE = re.compile(
    r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|menubar|header|masthead|footer|sidebar|side|aside|widget|ads?|adverts?|advertisement|advertising|adsense|adbox|sponsor|sponsored|promo|promoted|promotion"
    r"|banner|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|form|share|sharing|social|breadcrumbs?|pagination|pager|related|recommended"
    r"|complementary|contentinfo|toolbar|skip|legal|copyright)(?:$|[^a-z])"
)
COMMENTS = re.compile(r"(?<!no-)(?<!has-)(?<![a-z])(?:comments?|disqus|replies|reply|respond)(?![a-z]|[-_]?(?:open|closed|off|on|count|link|status)(?![a-z]))")
#: A sentence: some words and what ends one.
SENTENCE = re.compile(r"(?:\S+\s+){5}.*[.!?…。！？](?:[\"'”’»)\]]|\s|$)", re.DOTALL)
#: Blocks that end an open paragraph; of the second kind, one also ends an open one of its own name.
ENDS_PARAGRAPH = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6 div ul ol article section footer header nav aside table form main blockquote pre".split())
ENDS_ITSELF = frozenset("li dt dd tr td th option".split())


class Kind(NamedTuple):
    #: Beside the article, whatever it holds.
    aside: bool
    #: Beside it by its words (2: those of comments), unless it holds the article or most of the text.
    marked: int
    #: ``article`` or ``main``.
    article: bool


@lru_cache(maxsize=4096)
def _kind(name: str, attrs: str) -> Kind:
    """What an element is by its name and attributes. An attribute given twice counts as first given."""
    if name in ASIDE and name != "form":
        return Kind(True, 0, False)
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or UNSEEN.search(found.get("style", "")):
        return Kind(True, 0, False)
    marks = " ".join(found[k] for k in ("class", "id", "role", "aria-label") if k in found)
    marks = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", marks).lower()
    article = name in ("article", "main")
    if name in ("html", "body"):
        return Kind(False, 0, False)
    # an article isn't judged by words like "legal-notice"; one of a reader's comments is
    return Kind(False, 2 if COMMENTS.search(marks) else 1 if not article and (name == "form" or NOISE.search(marks)) else 0, article)


class Line(NamedTuple):
    text: str
    #: Characters in links.
    linked: int
    #: Beside the article, by the elements around it.
    aside: bool
    #: In an ``article`` or ``main``.
    inside: bool


class _Tree:
    """Elements that are marked by their words, or articles, with their text; each knows the one around it."""

    def __init__(self) -> None:
        self.above: list[int] = []
        self.size: list[int] = []
        self.kind: list[Kind] = []

    def add(self, above: int, kind: Kind) -> int:
        self.above.append(above)
        self.size.append(0)
        self.kind.append(kind)
        return len(self.above) - 1

    def beside(self, whole: int) -> list[bool]:
        """For each element whether it, or one around it, stands beside the article.

        A marked element that holds over half of the page's text doesn't; nor does one around the largest article, unless
        it is marked as comments.
        """
        for i in range(len(self.above) - 1, -1, -1):
            if self.above[i] >= 0:
                self.size[self.above[i]] += self.size[i]
        articles = [i for i, k in enumerate(self.kind) if k.article and not k.marked]
        holds = set()
        at = max(articles, key=lambda i: (self.size[i], -i), default=-1)
        while at >= 0:
            holds.add(at)
            at = self.above[at]
        out: list[bool] = []
        for i, kind in enumerate(self.kind):
            spared = 2 * self.size[i] > whole or (kind.marked == 1 and i in holds)
            out.append((kind.marked > 0 and not spared) or (self.above[i] >= 0 and out[self.above[i]]))
        return out


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*+>", re.IGNORECASE)


def line_blocks(page: str) -> list[Line]:
    """The page as lines, one for each block element; in time linear in the page's length.

    A quoted attribute value that is never closed is no quote: its tag ends at the next ``>``. A comment or a
    script that is never closed goes on to the end.
    """
    lines: list[tuple[str, int, bool, bool, int]] = []  # the last is the innermost element of the tree
    tree, within = _Tree(), -1
    parts: list[str] = []
    linked = whole = 0
    stack: list[tuple[str, Kind, int]] = []
    blocks: list[int] = []  # places in the stack of what isn't inline
    opened: Counter[str] = Counter()
    noise = inside = 0
    last_quote = {q: page.rfind(q) for q in "\"'"}

    def flush() -> None:
        nonlocal linked, whole
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
            if text:
                lines.append((text, linked, noise > 0, inside > 0, within))
                if not noise:
                    whole += len(text)
                    if within >= 0:
                        tree.size[within] += len(text)
            parts.clear()
        linked = 0

    def take(start: int, end: int) -> None:
        nonlocal linked
        if start < end:
            parts.append(page[start:end])
            if opened["a"]:
                linked += end - start

    def close(down_to: int) -> None:
        nonlocal noise, inside, within
        while len(stack) > down_to:
            n, kind, within = stack.pop()
            opened[n] -= 1
            noise -= kind.aside
            inside -= kind.article
        while blocks and blocks[-1] >= down_to:
            blocks.pop()

    def tag_end(at: int) -> int:
        while (m := IN_TAG.search(page, at)) is not None:
            if m[1] is None:
                return m.end()
            at = page.find(m[1], m.end()) + 1 if m.end() <= last_quote[m[1]] else m.end()
        return len(page)

    text_from = at = 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            take(text_from, at)
            end = page.find("]]>", at)
            parts.append(html.escape(page[at + 9 : len(page) if end < 0 else end]))
            text_from = at = len(page) if end < 0 else end + 3
            continue
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
        else:
            m = NAME.match(page, at)
            if m is None:
                at += 1
                continue
            end = tag_end(m.end())
            take(text_from, at)
            text_from = at = end
            name = m[2].lower()
            if name not in INLINE:
                flush()
            if m[1]:
                if opened[name] > 0 and name not in VOID:
                    down_to = len(stack) - 1
                    while stack[down_to][0] != name:
                        down_to -= 1
                    close(down_to)
                continue
            if name in RAW:
                found = _end_of(name).search(page, at)
                text_from = at = found.end() if found else len(page)
                continue
            attrs = page[m.end() : end].removesuffix(">")
            if name in VOID or attrs.endswith("/"):
                continue
            if name in ENDS_PARAGRAPH and blocks:
                # a paragraph, and what is open within it, ends where a block begins
                n = stack[blocks[-1]][0]
                if n == "p" or (n == name and name in ENDS_ITSELF):
                    close(blocks[-1])
            kind = _kind(name, attrs)
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append((name, kind, within))
            if kind.marked or kind.article:
                within = tree.add(within, kind)
            opened[name] += 1
            noise += kind.aside
            inside += kind.article
            continue
        take(text_from, at)
        text_from = at = end
    take(text_from, len(page))
    flush()
    beside = tree.beside(whole)
    return [Line(text, n, aside or (at >= 0 and beside[at]), own) for text, n, aside, own, at in lines]


def line_weights(lines: list[Line], link_share: float = LINK_SHARE) -> list[int | None]:
    """What each line adds to a sum: its length; None for a line within the article that takes no room there.

    The elements around a line weigh it, they don't choose it: a line beside the article weighs nothing, as do lines
    outside of ``article`` and ``main`` on a page that has text in such. Elsewhere a line that mostly is links weighs
    nothing, unless it holds a sentence.
    """
    some = any(x.inside and not x.aside for x in lines)
    out: list[int | None] = []
    for x in lines:
        if x.aside:
            out.append(None if x.inside else 0)
        elif some:
            out.append(len(x.text) if x.inside else 0)
        else:
            out.append(0 if x.linked > link_share * len(x.text) and not SENTENCE.match(x.text) else len(x.text))
    return out


def regions(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """``(start, stop, peak)`` of the stretches of lines from a surge to the next dive.

    The sum at a line is that of its weight and those of the ``window - 1`` lines after it. A surge is a rise from nothing,
    a dive a fall to nothing; the peak is the largest sum between.
    """
    total = [0, *accumulate(weights)]
    n = len(weights)
    sums = [total[min(n, i + window)] - total[i] for i in range(n)]
    out: list[tuple[int, int, int]] = []
    start, peak = None, 0
    for i, x in enumerate([*sums, 0]):
        if x and start is None:
            start, peak = i, x
        elif x:
            peak = max(peak, x)
        elif start is not None:
            out.append((start, i, peak))
            start = None
    return out


def main_text(page: str, window: int = WINDOW, share: float = SURGE_SHARE, link_share: float = LINK_SHARE) -> str:
    """The text between surges and dives of the sums over ``window`` lines, joined by line feeds.

    On a page with an ``article`` or ``main`` every surge there counts, however low. On others a surge counts that reaches
    ``share`` of the page's largest sum or holds a sentence, and all lines from the first such surge to the last dive are
    the article's, lines of links included, but for those beside it by their elements. A ``br`` ends a line, as a block does.
    Null-like pages (empty, or with no text of weight) give an empty string.
    """
    lines = line_blocks(page)
    marked = any(x.inside and not x.aside for x in lines)
    own = [(x, w) for x, w in zip(lines, line_weights(lines, link_share), strict=True) if w is not None]
    found = regions([w for _, w in own], window)
    if not marked:
        least = share * max((peak for *_, peak in found), default=0)
        found = [(a, b, peak) for a, b, peak in found if peak >= least or any(w and SENTENCE.match(x.text) for x, w in own[a:b])]
        heavy = [i for a, b, _ in found for i in range(a, b) if own[i][1]]
        return "\n".join(x.text for x, _ in own[heavy[0] : heavy[-1] + 1] if not x.aside) if heavy else ""
    return "\n".join(x.text for a, b, _ in found for x, w in own[a:b] if w)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text``, the main text of each whole page, to the rows; a column of that name is replaced.

    Null or empty html, and pages with no text, give an empty string. One page is in
    memory at a time beside its batch, and no shuffle is needed.
    """
    pages = pages.drop("text") if html_col != "text" else pages
    names = pages.columns
    at = names.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(x.as_py() or "") for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(run, f"{schema}, text string")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLE_SQL: dict[str, str] = {}
