import random
import re
from collections import Counter
from html import unescape

import pyarrow as pa
import pyarrow.parquet as pq

from tallyforge.llm import html_text
from tests.llm.helpers import CLASHING

PRIOR = html_text.weights_of({})


def write_pages(folder, pages, ids=None, **extra):
    n = len(pages)
    columns = {"page_id": pa.array(ids or list(range(n)), pa.int64()), "url": pa.array([f"u{i}" for i in range(n)]), "html": pa.array(pages, pa.string())}
    columns |= {k: pa.array(v) for k, v in extra.items()}
    pq.write_table(pa.table(columns), f"{folder}/pages.parquet")
    return str(folder)


def by_template(html):
    """The test pages hold their article in one element of paragraphs and headings; plain cutting suffices for them."""
    article = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", article)
    blocks = (" ".join(unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in blocks)
    return "\n".join(b for b in blocks if b)


def test_given_pages_match_their_template(spark, sf_dir):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = html_text.op4_max_subsequence(spark, sf_dir).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.text == by_template(html[r.page_id]) and r.n_chars == len(r.text)


FULL = """<html><head><title>T</title><style>p{}</style></head><body><header class="site"><h1>Site name</h1></header>
<nav>Home About</nav><div class="cookie-notice">We use cookies here and there</div><main><div id="sidebar">Old news of the day</div>
<article><header><h1>The  title</h1></header><p>First&nbsp;para &lt;b&gt; &amp; <b>bold</b>ly<br>on.</p><aside>Pull quote</aside>
<form><label>Mail</label><input></form><ul><li>one</li><li>two</li></ul><div class="ad-slot">Buy it now</div>
<script>var x = "<p>no</p>";</script><p>Last &#233;t&eacute; one<!-- not <p>this</p> --></p>
<section class="comments"><article class="comment"><p>I disagree with all of it, really, with every word of it</p></article></section>
</article></main><footer>All rights reserved by somebody somewhere</footer></body></html>"""


def test_what_is_not_content_goes():
    want = "The title\nFirst para <b> & boldly on.\none\ntwo\nLast été one"
    assert html_text.main_text(FULL, PRIOR) == want


def test_page_without_labels_takes_the_best_run():
    page = "<body><ul>" + "<li><a href=x>link</a></li>" * 20 + "</ul><div><h1>Head</h1><p>" + "word " * 60 + "</p><p>" + "more " * 40 + "</p></div>"
    page += "<ul>" + "<li><a href=y>other link</a></li>" * 20 + "</ul></body>"
    assert html_text.main_text(page, PRIOR) == "\n".join(["Head", " ".join(["word"] * 60), " ".join(["more"] * 40)])


def test_scan_finds_the_maximum_like_all_pairs():
    rng = random.Random(0)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randrange(25))]
        start, end = html_text.best_run(scores)
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        best = max(sums.values(), default=0.0)
        assert (start, end) == (0, 0) if best <= 0 else sums[start, end] == best


def test_main_text_is_the_text_of_the_best_run():
    rng = random.Random(1)
    for _ in range(100):
        page = "".join(rng.choice(["<div>", "<li>", "<p>", "alpha ", "beta gamma ", "<a>", "</a>", "</div>"]) for _ in range(30))
        found = html_text.parsed(page)
        scores, gone = html_text.scored(found, PRIOR)
        assert not any(gone)
        sums = [(sum(scores[i:j]), -i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        best = max(sums, default=(0.0, 0, 0))
        words = [w for kind, value, _ in found.tokens[-best[1] : best[2]] if kind == "text" for w in value.split()] if best[0] > 0 else []
        start, end = html_text.best_run(scores)
        assert abs(sum(scores[start:end]) - max(best[0], 0)) < 1e-9
        own = [w for kind, value, _ in found.tokens[start:end] if kind == "text" for w in value.split()]
        assert html_text.main_text(page, PRIOR).split() == own and len(own) <= len(words) + 3


def unlabelled(html):
    """A test page whose elements do not tell what they hold: no article, nav, footer or class."""
    html = re.sub(r"</?article>", "", html).replace(' class="ad"', "")
    return re.sub(r"<(/?)(?:nav|footer)>", r"<\1div>", html)


def test_pages_without_labels_by_weights_of_labelled_ones(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = html_text.learn_weights(pages)
    both = found = wanted = 0
    for r in pages.collect():
        got, want = Counter(html_text.main_text(unlabelled(r.html), model).split()), Counter(by_template(r.html).split())
        both, found, wanted = both + (got & want).total(), found + got.total(), wanted + want.total()
    assert both >= 0.95 * found and both >= 0.95 * wanted


def test_several_labels_are_all_kept():
    two = "<body><nav>Home</nav><article><p>First of the articles</p></article><article><p>Second of the articles</p></article></body>"
    assert html_text.main_text(two, PRIOR) == "First of the articles\nSecond of the articles"
    nested = "<main><h1>Title of it</h1><p>A lead</p><article>The body of it</article><p>And the rest</p></main>"
    assert html_text.main_text(nested, PRIOR) == "Title of it\nA lead\nThe body of it\nAnd the rest"


def test_names_that_only_resemble_boilerplate_keep_their_text():
    for tag in ("article class='post tag-search'", "main class='has-sidebar'", "div class='content no-sidebar'", "article class='post comments-open'"):
        page = f"<body><{tag}><p>All of the text</p><div class='share-price'>Price of a share</div><p>More of the text</p></{tag.split()[0]}></body>"
        assert html_text.main_text(page, PRIOR) == "All of the text\nPrice of a share\nMore of the text"
    assert html_text.main_text("<article><section id='search-engines'><p>On engines of search</p></section></article>", PRIOR) == "On engines of search"


def test_names_outside_content_are_learned():
    page = "<body><div class='zq-teaser'>" + "buy it all now " * 20 + "</div><article><p>" + "word " * 50 + "</p></article></body>"
    counts = Counter()
    for _ in range(20):
        counts.update(html_text.label_counts(page))
    model = html_text.weights_of(counts)
    assert "zq-teaser" in model.outside
    later = "<body><article><p>Some words first</p><div class='zq-teaser'>buy it</div><p>Some words last</p></article></body>"
    assert html_text.main_text(later, model) == "Some words first\nSome words last"
    shown = html_text.weights_of(Counter({("name:ad", True): 10**6}))
    assert "ad" not in shown.outside and "ad" in PRIOR.outside


def test_tags_end_where_browsers_end_them():
    want = "words of the first part two words of the last part"
    for inner in ("<a title=don't href=x>two</a>", "<a b = '>' c>two</a>", "<a b=>two</a>", "<!-->two<!-- - --!>", "<b x==\">two</b>", "<?x>two</3>"):
        assert html_text.main_text(f"<article><p>words of the first part {inner} words of the last part</p></article>", PRIOR) == want
    assert html_text.main_text("<article><p>one two</p><img src=\"never ends > <p>three</p></article>", PRIOR) == "one two"


def test_deep_and_unbalanced_pages_take_linear_time():
    deep = "<b>" * 100_000 + "text of it " + "</i>" * 100_000 + "<hr>" * 100_000 + "</b>" * 100_000
    assert html_text.main_text(deep, PRIOR) == "text of it"


def test_edge_rows(spark, tmp_path):
    pages = [None, "", "plain text  only", "<p>a < b and c > d</p>", "<script>x", "<nav>menu</nav>", "<p>" + "w " * 200_000, "<a <a <a " * 5000, "<p>same", "<p>same"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    extra = {name: [value] * len(pages) for name, value in {**CLASHING, "text": 1, "n_chars": 1}.items()}
    rows = sorted(html_text.op4_max_subsequence(spark, write_pages(tmp_path, pages, ids, **extra)).collect())
    texts = [r.text for r in rows]
    assert texts[:6] == ["", "", "plain text only", "a < b and c > d", "", ""] and texts[8:] == ["same", "same"]
    assert rows[6].n_chars == 399_999
    empty = tmp_path / "empty"
    empty.mkdir()
    assert html_text.op4_max_subsequence(spark, write_pages(empty, [])).collect() == []


def test_attributes_of_any_length_belong_to_their_tag():
    for quote in "\"'":
        page = f"<body><div class=nav data-x={quote}{'menu > ' * 15_000}{quote}>Home About</div><article><p>All of the text</p></article></body>"
        assert html_text.main_text(page, PRIOR) == "All of the text"


def sentences(rng, n, words=12):
    return [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(words)) for _ in range(n)]


def kinds_of_pages():
    """(name, html of an article's inside, its words): structures that the test tables do not show."""
    rng = random.Random(8)
    long, short = sentences(rng, 10), sentences(rng, 20, 2)
    p = lambda x: f"<p>{x}</p>"
    plain = "".join(map(p, long[:3]))
    made = {
        "div paragraphs": "".join(f"<div>{x}</div>" for x in long),
        "a table between": p(short[0]) + "<table>" + "".join(f"<tr><td>{x.split()[0]}</td><td>{x.split()[1]}</td></tr>" for x in short) + "</table>" + plain,
        "a list of links between": p(short[0]) + "<ul>" + "".join(f"<li><a href=/x>{x}</a></li>" for x in short) + "</ul>" + plain,
        "linked items alone": "<ol>" + "".join(f"<li><a href=/x>{x}</a></li>" for x in short) + "</ol>",
        "a byline in a div": f"<h1>{short[1]}</h1><div class=zz-by>{short[2]}</div>" + plain,
        "nested divs": f"<div><div><div>{long[0]}</div><div><span>{long[1]}</span></div></div></div>" + plain,
        "sections and definitions": f"<section><h2>{short[3]}</h2><dl><dt>{short[4]}</dt><dd>{long[2]}</dd></dl></section>" + plain,
        "details and figures": f"<details><summary>{short[5]}</summary>{p(long[3])}</details><figure><img src=x><figcaption>{short[6]}</figcaption></figure>" + plain,
        "own elements": f"<x-note><x-line>{long[4]}</x-line></x-note>" + plain,
        "headings only": "".join(f"<h2>{x}</h2>" for x in short),
    }
    return {name: (inner, re.sub(r"<[^>]*>", " ", inner).split()) for name, inner in made.items()}


def test_ten_kinds_of_articles_come_whole(spark, sf_dir):
    """By the weights of the given pages, in which an article holds paragraphs and a heading and nothing else."""
    model = html_text.learn_weights(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    around = "<nav><ul><li><a href=/>Home page</a></li></ul></nav><div class='ad'>Buy all of this today</div>{}<div>Loose words after it</div><footer>All rights reserved</footer>"
    for name, (inner, words) in kinds_of_pages().items():
        for label in ("article", "main"):
            got = html_text.main_text("<body>" + around.format(f"<{label}>{inner}</{label}>") + "</body>", model).split()
            both = (Counter(got) & Counter(words)).total()
            assert both >= 0.95 * len(words) and both >= 0.95 * len(got), (name, label)
        two = html_text.main_text("<body>" + around.format(f"<article>{inner}</article><article>{inner}</article>") + "</body>", model).split()
        assert (Counter(two) & Counter(words + words)).total() >= 0.95 * 2 * len(words), name


def test_the_scan_is_what_leaves_things_out(spark, sf_dir, monkeypatch):
    model = html_text.learn_weights(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    page = "<body><div>Home</div><div><a href=x>About</a></div><article><p>" + "word " * 40 + "</p></article><div>Imprint</div></body>"
    assert html_text.main_text(page, model) == " ".join(["word"] * 40)
    monkeypatch.setattr(html_text, "best_run", lambda scores: (0, len(scores)))
    assert html_text.main_text(page, model) != " ".join(["word"] * 40)
