"""Main text of pages against plain readings and hand-made pages."""

import html as H
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tokenfold.llm import pages as P
from tokenfold.llm import queries

PROSE = "The house of the old man is in the middle of the town, and it was not far from the river that he had seen as a child, which is why he came to it."


class Article(HTMLParser):
    """Texts of the paragraphs and headings of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.texts = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1"):
            self.texts.append("")
        if tag == "br":
            self.texts[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1"):
            self.texts.append("")

    def handle_data(self, data):
        if self.inside:
            self.texts[-1] += data


def article(html):
    read = Article()
    read.feed(html)
    read.close()
    return "\n".join(t for t in (" ".join(x.split()) for x in read.texts) if t)


def test_query_equals_the_articles_of_the_table(spark):
    got = queries.op12_block_rules(spark, "/root/testdata/sf0.001").collect()
    rows = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert sorted(r.page_id for r in got) == sorted(rows)
    for r in got:
        assert r.text == article(rows[r.page_id].html) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


def plain_second_pass(page):
    labels = []
    for i, b in enumerate(page):
        if b.label is not None:
            labels.append(b.label)
            continue
        reach = [j for j, o in enumerate(page) if o.region == b.region and o.kind != P.BOILERPLATE and not (o.kind == P.ARTICLE_HEADER and o.label is False)]
        here = reach.index(i)
        near = [(abs(reach.index(j) - here), page[j].label) for j in reach if page[j].label is not None]
        least = min((d for d, _ in near), default=None)
        found = [label for d, label in near if d == least]
        keeps = b.region or b.kind == P.CONTENT or len(b.text) >= P.SHORT
        labels.append(True if not found else any(found) if keeps else all(found))
    return labels


def test_second_pass_equals_a_plain_search():
    rng = random.Random(4)
    for _ in range(300):
        page = [P.Block("x" * rng.choice([5, 90]), rng.choice([P.UNKNOWN, P.UNKNOWN, P.CONTENT, P.BOILERPLATE]), rng.choice([0, 0, 1, 2]), 0.0, False,
                        rng.choice([True, False, None, None])) for _ in range(rng.randrange(12))]
        for b in page:
            b.label = False if b.kind == P.BOILERPLATE else b.label
        want = plain_second_pass(page)
        P.second_pass(page)
        assert [b.label for b in page] == want


@pytest.mark.parametrize("around", [
    "<nav>{}</nav>", "<header><p>{}</p></header>", "<footer>{}</footer>", "<aside>{}</aside>", "<div class='sidebar-left'>{}</div>",
    "<div id=cookieNotice><p>{}</div>", "<div class=ad>{}</div>", "<section class='reader-comments'><article><p>{}</p></article></section>",
    "<form action=x>{}<input name=q></form>", "<script>var a = '{}';</script>", "<style>{}</style>", "<!-- {} -->", "<noscript>{}</noscript>",
    "<div role=navigation>{}</div>", "<p hidden>{}</p>", "<div style='display: none'>{}</div>", "<ul class=menu><li>{}</ul>", "<dialog open>{}</dialog>",
    "<span class=sponsored>{}</span>", "<template><p>{}</p></template>", "<select><option>{}</select>",
])
@pytest.mark.parametrize("inside", [True, False])
def test_parts_around_an_article_go(around, inside):
    other = around.format("The notes of the others are in this part, and that is not of the article as it was written by all who were there with us.")
    body = f"<h1>Of rivers</h1><p>{PROSE}{other if inside else ''}<p>Short.<p>{PROSE}"
    page = f"<html><head><title>T</title></head><body>{'' if inside else other}<article>{body}</article>{'' if inside else other}</body>"
    assert P.main_text(page)[0] == f"Of rivers\n{PROSE}\nShort.\n{PROSE}"


def test_pages_without_an_article_element_are_judged_by_words_and_links():
    links = "".join(f"<li><a href=/{k}>The way to the place {k}</a></li>" for k in range(6))
    odd = "zz qq xx vv kk " * 20
    page = f"<body><div>Menu</div><ul>{links}</ul><div>{PROSE * 2}</div><div>Short.</div><div>{PROSE * 2}</div><div>{odd}</div><ul>{links}</ul><p>&copy; The house</p>"
    assert P.main_text(page)[0].split("\n") == [PROSE * 2, "Short.", PROSE * 2]


def test_markup_details():
    read = lambda h: P.main_text(h)[0]
    assert read("<article><P>a&amp;lt;b &#x41;&eacute;&nbsp;&ampx &am <b>x</b>y<br>z\n\t w<td>c</article>") == "a&lt;b Aé &x &am xy z w\nc"
    assert read('<article><p title="a>b">one</p><p title=it\'s>two</p><p data-x=\'">three</article>') == "one\ntwo\nthree"
    assert read("<article><script>if (a<b) '</p>'</script><p>x < y, 3<4</p><p>end") == "x < y, 3<4\nend"
    assert read("<article><ul><li>a<li>b<ul><li>c</ul><li class=ad>no<li>d</ul><table><tr><td>1<td>2<tr><td>3</table></article>") == "a\nb\nc\nd\n1\n2\n3"
    assert read("<article><p>a<br><br>b</p></article>") == "a\nb"
    assert read("<article><header><h2>Head</h2><p>by nobody</p></header><p>x</p></article>") == "Head\nx"
    assert read("<form id=all><nav>menu</nav><main><p>x</p></main></form>") == "x"
    assert read("<article><p>one<!-- open <p>two") == "one"
    assert read("<body class='no-sidebar has-menu'><div class=has-comments><article>x</article></div>") == "x"
    assert read("plain text\nonly") == "plain text only" and read("") == "" and read("<p></p>") == "" and read("<article></article>") == ""
    assert read(f"<article>{'<p>x<a href=/>y</a></p>' * 3}<p>{PROSE}</article>") == "xy\nxy\nxy\n" + PROSE


def test_page_table_with_odd_rows(spark):
    rows = [(1, None, "u"), (1, "", "u"), (None, "<article>x</article>", None), (2, "<article>x</article>", "u"), (2, "<article>x</article>", "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string").withColumn("row", F.lit(1)).withColumn("n_chars", F.lit(2))
    got = P.page_texts(df).collect()
    assert sorted((str(r.row.page_id), r.row.text, r.row.n_chars, r.text, r.n_chars) for r in got) == sorted(
        (str(i), u, 2, "x" if h else "", 1 if h else 0) for i, h, u in rows)
    assert P.page_texts(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert P.page_texts(spark.createDataFrame([("a",)], "html string")).first().text == "a"


def test_long_and_broken_pages_take_linear_time():
    rng = random.Random(6)
    soup = [f"<{t}>" for t in "div p b li ul article a td h1 form".split()] + [f"</{t}>" for t in "div p b li ul article a td".split()] + ["x", " the ", "<", "&", "<br>", "<a href='"]
    for _ in range(200):
        P.main_text("".join(rng.choice(soup) for _ in range(rng.randrange(60))))
    start = time.time()
    for piece in ("<div>", "<b>", "<p class='x", "<li>", "<b><p>", "<a href=\"x", "&amp", "<!-- ", "</div>", "<article><p>"):
        P.main_text(piece * 60_000 + "<p>x</p>" * 1_000)
    text = "\n".join([PROSE] * 20_000)
    assert P.main_text("<article>" + "".join(f"<p>{H.escape(x)}</p>" for x in text.split("\n")))[0] == text
    assert time.time() - start < 60
