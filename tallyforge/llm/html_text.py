"""Main text of web pages by a maximum-scoring subsequence of words and tags.

Words score positive and tags negative; the contiguous run of tokens with the largest sum is
the content (Pasternack and Roth, 2009), found in one scan. Weights are log odds of being
inside the content, counted over all pages that label it themselves with an article or main
element, joined with a few pseudo-counts for tables without such pages. That a token lies within a label is
one more feature: labelled pages show only content there, so any tag costs no more than a content one and no
word scores less than in a plain paragraph. Label tags themselves score nothing, and on every page, labelled or not,
the scan alone decides where content begins and ends. Elements that are no content by the standard, or whose class or id the labelled pages show
outside content, have no score and leave the run that was chosen.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, table

# fixed values of the HTML standard: element names by their part in a page
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody "
    "tfoot thead title tr ul".split()
)
SPACING = frozenset("br td th img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
LABELS = frozenset(("article", "main"))
DROPPED = frozenset(
    "aside button canvas datalist dialog embed footer form head iframe map math menu nav noembed noframes noscript object "
    "script search select style svg template textarea title video audio xmp".split()
)
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong br blockquote pre code figure figcaption q cite sup sub".split())
OTHERS = frozenset("a div span img input label section".split())
LISTS = frozenset("li ul ol td tr table dd dl dt".split())
KNOWN = BLOCKS | SPACING | VOID | DROPPED | CONTENT | OTHERS | LISTS
# fixed values of the ARIA standard: roles of what is not content
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split())

#: Pseudo-counts, in words outside content, of class and id names before any labelled page is seen.
PRIOR_NAMES = frozenset(
    "ad ads ad-slot adslot advert advertisement banner breadcrumb breadcrumbs comment comments comment-list comments-area "
    "cookie-notice cookie-banner disqus_thread footer header menu nav navbar newsletter popup promo related related-posts "
    "respond share-buttons sidebar site-footer site-header social-share sponsored widget".split()
)
PRIOR_WORDS = 1000
#: Share of an element's words that lies outside content before its class or id stands for no content.
OUTSIDE_SHARE = 0.95
#: Class and id names in the model: those on the most words. Names of a task are handed on in parts of FLUSH.
MODEL_NAMES, FLUSH = 10_000, 50_000

#: Score of a tag that belongs to content, and of one that no label page shows.
SLIGHT, UNSEEN = -0.01, -1.5

_VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+"
#: Comments and declarations, or a tag as browsers read it: a quote opens a value only after an equals sign.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^A-Za-z][^>]*+(?:>|\Z)"
    rf"|<(/?)([A-Za-z][^\s/>]*+)((?:[^=>]++|=\s*+(?:{_VALUE})?+)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(rf"(?<![^\s/\"'])(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+({_VALUE})|(?=[\s/]|\Z))|=\s*+(?:{_VALUE})", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    """An open tag of a page: its parent, whether a browser shows no content in it, and its class and id names."""

    parent: int
    name: str
    out: bool
    names: tuple[str, ...] = ()
    labelled: bool = False
    held: bool = False  # the page's first label element lies within


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    tokens: list[tuple[str, str, int]] = field(default_factory=list)  # kind, value, element


def _described(attributes: str) -> tuple[bool, tuple[str, ...]]:
    """(a browser hides it or its role is no content, class and id names)."""
    out, names = False, []
    for found in ATTRIBUTE.finditer(attributes):
        if not found[1]:
            continue
        key, value = found[1].lower(), (found[2] or "").strip("\"'")
        if key in ("class", "id"):
            names += value.lower().split()
        elif key == "role":
            out |= any(x in ROLES for x in value.lower().split())
        elif key == "style":
            out |= bool(INVISIBLE.search(value))
        else:
            out |= key == "hidden" or value.lower() == "true"
    return out, tuple(dict.fromkeys(names))


def parsed(html: str) -> Page:
    """The page's tokens in order, (open, close or text; tag or text; number of the element), and its elements.

    Elements are followed with a stack as browsers do in outline: a void element holds nothing, a
    block ends an open paragraph, an end tag closes down to its element if that is open, and is
    ignored otherwise; an inline end tag looks no further than the block it stands in. Each step
    takes constant time in the depth of the page, or closes what it passes.
    """
    page = Page([Element(0, "", False)])
    elements, out = page.elements, page.tokens
    stack: list[int] = [0]
    places: dict[str, list[int]] = {}  # depths at which elements of a name are open
    blocks: list[int] = []  # depths of the open blocks
    first_label = True
    at, size = 0, len(html)

    def close(depth: int) -> None:
        while len(stack) > depth:
            name = elements[stack.pop()].name
            places[name].pop()
            if name in BLOCKS:
                blocks.pop()

    while at < size:
        found = TOKEN.search(html, at)
        start = found.start() if found else size
        if start > at:
            out.append(("text", html[at:start], stack[-1]))
        if not found:
            break
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            out.append(("close", name, stack[-1]))
            depth = places.get(name)
            if depth and (name in BLOCKS or not blocks or depth[-1] > blocks[-1]):
                close(depth[-1])
            continue
        if name in BLOCKS and blocks:
            inner = elements[stack[blocks[-1]]].name
            if inner == "p" or inner == name == "li" or (inner in ("dd", "dt") and name in ("dd", "dt")):
                close(blocks[-1])
        parent = elements[stack[-1]]
        hidden, names = _described(found[3]) if found[3] and name not in ("html", "body") else (False, ())
        header = name == "header" and not parent.labelled
        element = Element(stack[-1], name, hidden or header or name in DROPPED, names, parent.labelled or name in LABELS)
        number = len(elements)
        elements.append(element)
        if name in LABELS and first_label and not element.out:
            first_label = False
            while number and not elements[number].held:
                elements[number].held = True
                number = elements[number].parent
        number = len(elements) - 1
        out.append(("open", name, number))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
        elif name not in VOID and not found[3].endswith("/"):
            places.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks.append(len(stack))
            stack.append(number)
    return page


def label_counts(html: str) -> Counter:
    """(feature, inside content) -> occurrences, for a page that labels its content; else nothing.

    Features are tags, word:tag for words after a tag, and name:x for words in elements of class or id x.
    Tags and words of elements that are no content by the standard take no part, as they are never scored.
    """
    page = parsed(html)
    dropped = [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        dropped[i] = e.out or dropped[e.parent]
    found: Counter = Counter()
    own = [[0, 0] for _ in page.elements]
    block, seen = "body", False
    for kind, value, number in page.tokens:
        inside = page.elements[number].labelled and not dropped[number]
        seen |= inside
        if kind == "text":
            words = len(value.split())
            if not dropped[number]:
                found[f"word:{block}", inside] += words
            own[number][inside] += words
            continue
        if value in BLOCKS or value == "a":
            block = value if kind == "open" else "body"
        if value not in LABELS and not dropped[number]:
            found[value, inside] += 1
    if not seen:
        return Counter()
    for i in range(len(page.elements) - 1, 0, -1):
        e = page.elements[i]
        for name in e.names:
            found[f"name:{name}", False] += own[i][0]
            found[f"name:{name}", True] += own[i][1]
        own[e.parent][0] += own[i][0]
        own[e.parent][1] += own[i][1]
    return found


@dataclass(frozen=True)
class Model:
    """Scores of tags and of words by the tag before them; class and id names that stand for no content."""

    scores: dict[str, float]
    outside: frozenset[str]


def learn_weights(pages: DataFrame, html_col: str = "html") -> Model:
    """The model of all pages that label their content.

    Tags beyond the HTML standard's share one entry. Counts are summed by Spark; the driver takes those of
    the known tags and of the MODEL_NAMES class and id names on the most words, which bounds the model.
    """

    def batch_of(sums: Counter) -> pa.RecordBatch:
        names, insides, ns = zip(*[(name, inside, n) for (name, inside), n in sums.items()] or [("other", False, 0)])
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(insides), pa.array(ns, pa.int64())], ["name", "inside", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for html in batch.column(0):
                for (name, inside), n in label_counts(html.as_py() or "").items():
                    known = name.startswith("name:") or name.split(":")[-1] in KNOWN
                    sums[name if known else "other", inside] += n
                if len(sums) > FLUSH:
                    yield batch_of(sums)
                    sums.clear()
        yield batch_of(sums)

    counts = pages.select(F.col(html_col).cast("string")).mapInArrow(counted, "name string, inside boolean, n long")
    sums = counts.groupBy("name").agg(*[F.sum(F.when(F.col("inside") == x, F.col("n")).otherwise(0)).alias(c) for x, c in ((True, "a"), (False, "b"))])
    sums = cut(sums, "tag-counts")  # so that the pages are read once
    is_name = F.col("name").startswith("name:")
    tags = sums.where(~is_name).collect()  # at most two for each known tag
    most = F.col("a") + F.col("b")
    names = sums.where(is_name & (F.col("b") > F.col("a"))).orderBy(most.desc(), "name").limit(MODEL_NAMES).collect()
    inside = sums.where(is_name & F.col("name").isin([f"name:{x}" for x in PRIOR_NAMES])).collect()  # at most the names listed
    return weights_of({(r.name, x): r[c] for r in [*tags, *names, *inside] for x, c in ((True, "a"), (False, "b"))})


def weights_of(counts: dict[tuple[str, bool], int]) -> Model:
    """Clipped log odds: tags never score above SLIGHT, words never below 0.1."""
    inside: dict[str, float] = defaultdict(float)
    outside: dict[str, float] = defaultdict(float)
    for (name, within), n in counts.items():
        (inside if within else outside)[name] += n
    for name in CONTENT:
        inside[name] += 5
    for name in OTHERS:
        outside[name] += 5
    for name in LISTS:
        outside[name] += 0.3
    for name in PRIOR_NAMES:
        outside[f"name:{name}"] += PRIOR_WORDS
    features = inside.keys() | outside.keys()
    names = {n for n in features if n.startswith("name:")}
    out = {}
    for n in features - names:
        odds = log((inside[n] + 1) / (outside[n] + 1))
        out[n] = min(max(odds, 0.1), 3.0) if n.startswith("word:") else min(max(odds, -5.0), SLIGHT)
    bad = {n[5:] for n in names if outside[n] >= OUTSIDE_SHARE * (inside[n] + outside[n] + 1)}
    return Model(out, frozenset(bad))


def scored(page: Page, model: Model) -> tuple[list[float], list[bool]]:
    """The score of each token, and which of them lie in elements that are no content."""
    gone = [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        gone[i] = gone[e.parent] or e.out or (not e.held and any(x in model.outside for x in e.names))
    scores, block = [], "body"
    for kind, value, number in page.tokens:
        within = page.elements[number].labelled
        if kind == "text":
            score = model.scores.get(f"word:{block}", 1.0)
            scores.append(0.0 if gone[number] else len(value.split()) * (max(score, 1.0) if within else score))
            continue
        if value in BLOCKS or value == "a":
            block = value if kind == "open" else "body"
        score = model.scores.get(value, UNSEEN)
        scores.append(0.0 if gone[number] or value in LABELS else max(score, SLIGHT) if within else score)
    return scores, [gone[number] for _, _, number in page.tokens]


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the largest sum, empty if no sum is positive: one linear scan."""
    best, run = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, run = total, (start, i + 1)
    return run


def main_text(html: str | None, model: Model) -> str:
    """The blocks of the best-scoring run of tokens, one a line."""
    if not html:
        return ""
    page = parsed(html)
    scores, gone = scored(page, model)
    start, end = best_run(scores)
    lines: list[str] = []
    parts: list[str] = []
    for (kind, value, _), out in zip(page.tokens[start:end], gone[start:end]):
        if kind == "text":
            if not out:
                parts.append(value)
        elif value in BLOCKS:
            lines.append("".join(parts))
            parts = []
        elif value in SPACING:
            parts.append(" ")
    lines.append("".join(parts))
    return "\n".join(x for x in (" ".join(unescape(line).split()) for line in lines) if x)


def with_main_text(pages: DataFrame, model: Model, html_col: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page; a column named like `out` is replaced. Rows are handled one by one."""
    handed = pages.sparkSession.sparkContext.broadcast(model)  # known tags and at most MODEL_NAMES names

    @F.pandas_udf("string")
    def extracted(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(None if x is None or x is pd.NA else x, handed.value) for x in html], dtype=object)

    return pages.withColumn(out, extracted(F.col(html_col).cast("string")))


def op4_max_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages: page_id, url, text, n_chars.

    Null and empty html, and pages of nothing but boilerplate, have an empty text. Repeated rows and
    null ids are kept. An empty table gives no rows; other columns are not read.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = with_main_text(pages, learn_weights(pages))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
