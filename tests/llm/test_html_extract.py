import html
import re

import duckdb
import pytest

from brindle.llm.html_extract import extracted, main_text

ARTICLE = ["A heading & more", "First paragraph with enough words to look like text, and a link.", "Second < one, long enough as well to be text.", "item one", "item two", "Third, after the list."]


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


BODY = """<h1>A heading &amp; more</h1><p>First <b>para</b>graph with
 enough   words to look like text, and <a href="x>y">a link</a>.<p>Second &lt; one, long enough as well to be text.</p>
<ul><li>item one<li>item two</ul><div>Third,<br>after the list.</div>"""
AROUND = [
    ("", ""),
    ("<nav><ul><li><a href=/>Home page link text</a></ul></nav><header><h2>Site name and slogan</h2></header>", "<footer>&copy; footer words that are long enough to be read as text by any measure</footer>"),
    ('<div class="ad">Buy now, a long advert text with many words, much like a real text is.</div><script>var x = "<p>no</p>";</script><style>p{}</style>', '<aside>sidebar text</aside><div class="comments"><p>A reader comment of some length, as long as a paragraph is.</p><p>Another reader comment that goes on.</p></div>'),
    ('<div id="cookie-notice"><p>We use cookies to make this site better for you and all.</p></div><form><label>Name</label><input name=a><select><option>x</select></form>', "<!-- <p>hidden</p> --><section class='related'><h3>More</h3><p>Read this too, it is good.</p></section>"),
]


@pytest.mark.parametrize("before,after", AROUND)
@pytest.mark.parametrize("tag", ["article", "main", 'div class="content"', 'section id="post"'])
def test_article_among_boilerplate(before, after, tag):
    text = main_text(page(f"{before}<{tag}>{BODY}</{tag.split()[0]}>{after}"))
    assert text == "\n".join(ARTICLE)


LINKS = "<div>" + "".join(f"<a href=/{i}>some link {i}</a> " for i in range(30)) + "</div>"


@pytest.mark.parametrize("around", ["", LINKS])
@pytest.mark.parametrize("wrapper", ["<div id=content>{}</div>", "{}", "<div><div>{}</div></div>"])
def test_all_sections_and_the_heading_without_an_article_element(around, wrapper):
    paragraph = "words of a paragraph " * 19
    sections = "<h1>A heading, 20 chars.</h1>" + "".join("<div>" + f"<p>{paragraph}</p>" * n + "</div>" for n in (5, 3))
    want = ["A heading, 20 chars.", *[paragraph.strip()] * 8]
    assert main_text(page(around + wrapper.format(sections) + around)) == "\n".join(want)


def test_comments_inside_the_article_and_cut_off_pages():
    inner = BODY + '<section class="comment-list"><div class="comment"><p>Reader: nice.</p></div></section>'
    assert main_text(page(f"<article>{inner}</article>")) == "\n".join(ARTICLE)
    cut = page(f"<nav><a>x</a></nav><article>{BODY}")
    cut = cut[: cut.index("after the list.")]
    assert main_text(cut) == "\n".join([*ARTICLE[:-1], "Third,"])


@pytest.mark.parametrize("given,want", [(None, ""), ("", ""), ("   ", ""), ("just text &eacute;", "just text é"), ("<p>a</p><p>b  c</p>", "a\nb c"), ("<", "<"), ("<p", ""), ("a < b", "a < b"), ("<script>x", ""), ("</p></div>x", "x")])
def test_odd_pages(given, want):
    assert main_text(given) == want


def test_very_deep_and_long():
    assert main_text("<div>" * 20000 + "deep") == "deep"
    assert len(main_text(page("<article>" + "<p>word word</p>" * 50000 + "</article>"))) == 50000 * 10 - 1


@pytest.mark.parametrize("opening", ['<p title="The hidden valley">', '<p data-state="hidden">', '<p data-id="menu">', '<p class="search-and-rescue">', "<p title='a > b' id=related-work>", "<p aria-hidden=false style='color: red'>"])
def test_attributes_are_compared_not_searched(opening):
    inner = BODY.replace("<p>Second", f"{opening}Second")
    for tag in ("article", "div"):
        assert main_text(page(f"<nav><a href=/>x</a></nav><{tag}>{inner}</{tag}>")) == "\n".join(ARTICLE)


@pytest.mark.parametrize("opening", ["<p hidden>", "<p class=x HIDDEN=''>", "<p aria-hidden='true'>", "<p style='DISPLAY :none'>", "<p class='x ad-slot-2'>", "<p class=cookieNotice>"])
def test_marked_blocks_go(opening):
    inner = BODY.replace("<p>Second", f"{opening}Other words that can't be seen.</p><p>Second")
    assert main_text(page(f"<article>{inner}</article>")) == "\n".join(ARTICLE)


def test_sections_named_like_boilerplate_stay_in_an_article():
    inner = BODY.replace("<p>Second", "<section id=related-work><h2 id='search'>Search</h2><p id=login>On logging in.</p></section><p>Second")
    assert main_text(page(f"<article>{inner}</article>")) == "\n".join([*ARTICLE[:2], "Search", "On logging in.", *ARTICLE[2:]])


@pytest.mark.parametrize("opening", ["<section id=comments>", "<div id='disqus'>", "<div class='post-comments'>", "<div id=ad-slot-1>"])
def test_comments_by_their_id_go_from_an_article(opening):
    inner = BODY + f"{opening}<p>A reader comment of some length, as long as a paragraph.</p></{opening[1:].split()[0]}>"
    assert main_text(page(f"<article>{inner}</article>")) == "\n".join(ARTICLE)
    assert main_text(page(f"<div role=main id=search>{BODY}</div>")) == "\n".join(ARTICLE)


def test_form_around_the_page_and_nav_never_closed():
    form = f"<form id=aspnet><nav><a href=/>Home</a></nav><div>{BODY}</div><label>Name</label><select><option>x</select><button>Send it</button></form>"
    assert main_text(page(form)) == "\n".join(ARTICLE)
    assert main_text(page(f"<nav><ul><li><a href=/>Home</a><article>{BODY}</article>")).split("\n")[-len(ARTICLE) :] == ARTICLE


def test_threshold_leaves_out_what_is_not_marked():
    paragraph = "words of a paragraph " * 19
    around = "<div><ul>" + "".join(f"<li><a href=/{i}>some link {i}</a></li>" for i in range(30)) + "</ul></div><div><b>Teaser</b> <i>with</i> <u>few</u> <b>words</b></div>"
    assert main_text(page(f"<div>{around}<div><h1>Title of it</h1>{f'<p>{paragraph}</p>' * 4}</div>{around}</div>")) == "\n".join(["Title of it", *[paragraph.strip()] * 4])


def expected(raw):
    """The article of the test tables' pages, by their known frame."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", raw, re.S).group(1)
    inner = re.sub(r"<[^>]*\Z", "", inner)
    parts = re.split(r"</?(?:h1|p)>", inner)
    return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts) if t)


def test_tables(spark):
    rows = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for _, raw in rows:
        assert main_text(raw) == expected(raw)
        assert main_text(raw.replace("<article>", "<div>").replace("</article>", "</div>")) == expected(raw)
    df = spark.createDataFrame([(i, h, "x") for i, h in [*rows[:20], (-1, None), *rows[:2]]], "page_id long, html string, extracted string")
    out = extracted(df)
    assert out.columns == ["page_id", "html", "extracted", "_extracted"]
    for r in out.collect():
        assert r["_extracted"]["text"] == main_text(r.html) and r["_extracted"]["n_chars"] == len(main_text(r.html))
    assert extracted(df.limit(0)).count() == 0
