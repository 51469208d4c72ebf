import html as H
import re

from conftest import SF01

from pyspark.sql import functions as F

from wareloom.llm import op8_html as op


def page(body, head="<title>No title text</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{x}}</style></head><body>{body}</body></html>"


P = "A paragraph of the article that is long enough to be told from the surroundings, with some more words. "
MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About</a></li></ul></nav>"


def text(body, **k):
    return op.main_text(page(body, **k))[0]


def test_article_with_surroundings():
    body = (MENU + "<header>Site header</header><div class='cookie-notice'>We use cookies</div><aside>Side</aside><article><h1>Head &amp; line</h1>"
            f"<p>{P}<b>bold</b>&nbsp;&eacute;&#233;</p><p>Short.</p><div class='ad'>Buy</div><form>Name <input></form><ul><li>one<li>two</ul><script>x('</p>')</script>"
            f"<p>{P}\n  two   spaces</p></article><section id='comments'><article class='comment'><p>{P}</p></article></section><footer>&copy; 2024</footer>")
    want = ["Head & line", " ".join((P + "bold éé").split()), "Short.", "one", "two", " ".join((P + "two spaces").split())]
    assert text(body) == "\n".join(want)


def test_without_article_element():
    body = "<div class='menu'><a href='/'>x</a></div><div id='content'>" + "".join(f"<p>{P} {i}</p>" for i in range(6)) + "<p>Tiny.</p></div><div class='sidebar'>Links</div>"
    assert text(body).split("\n") == [f"{P.strip()} {i}" for i in range(6)] + ["Tiny."]


def test_link_lists_outside_an_article_go():
    body = "<div><ul>" + "".join(f"<li><a href='#'>Link {i}</a></li>" for i in range(10)) + "</ul></div><div>" + "".join(f"<p>{P} {i}</p>" for i in range(6)) + "</div>"
    assert text(body).split("\n") == [f"{P.strip()} {i}" for i in range(6)]


def test_split_sections_quotes_and_table_layouts_are_whole():
    many = "".join(f"<p>{P} {i}</p>" for i in range(9))
    lines = [f"{P.strip()} {i}" for i in range(9)]
    assert text(f"<section>{many}</section><section><p>{P} last</p></section>").split("\n") == [*lines, f"{P.strip()} last"]
    assert text(f"<p>Intro.</p><blockquote>{many}</blockquote><p>Outro.</p>").split("\n") == ["Intro.", *lines, "Outro."]
    assert text(f"<p>Intro.</p><table><tr><td>Key</td><td>{many}</td></tr></table>").split("\n") == ["Intro.", "Key", *lines]
    links = "".join(f"<li><a href='#'>Link {i}</a></li>" for i in range(10))
    layout = f"<table><tr><td><ul>{links}</ul></td></tr><tr><td>{many}</td></tr><tr><td><p>{P} last</p></td></tr></table>"
    got = [x for x in text(layout).split("\n") if not x.startswith("Link ")]
    assert got == [*lines, f"{P.strip()} last"] and "Link 0" not in text(layout)


def test_several_articles_stay_whole():
    long, short = f"{P} {P}".strip(), "A short one."
    assert text(f"<article><p>{long}</p></article><article><p>{short}</p></article>").split("\n") == [" ".join(long.split()), short]
    many = [f"{(P * (1 + k % 3)).strip()} {k}" for k in range(8)]
    assert text(MENU + "".join(f"<article><p>{x}</p></article>" for x in many) + "<footer>f</footer>").split("\n") == many
    cards = "".join(f"<article><a href='#'>Teaser {i}</a></article>" for i in range(5))
    assert text(f"<main><h1>Title</h1><article><p>{P}</p></article></main>{cards}").split("\n") == ["Title", P.strip()]


def test_names_count_as_a_whole():
    body = "<article>" + "".join(f"<p {a}>{P} {i}</p>" for i, a in enumerate(["class='notice-period'", "class='related-work'", "id='search-algorithms'", "class='comment-culture'"]))
    body += "".join(f"<div {a}>gone</div>" for a in ["class='cookie-notice'", "id='siteHeader'", "class='related-posts'", "class='x ad-slot'", "class='comment-list'", "role='search'"]) + "</article>"
    assert text(body).split("\n") == [f"{P.strip()} {i}" for i in range(4)]


def test_formulas_and_forms():
    assert text(f"<article><p>{P} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>").endswith("words. x=2")
    page_form = f"<form action='/'><input type='hidden'><nav>menu</nav><article><p>{P}</p><p>More.</p></article><label>Name</label><select><option>1</option></select><button>Go</button></form>"
    assert text(page_form) == text(page_form.replace("</form>", "")) == f"{P.strip()}\nMore."
    assert text(f"<article><p>{P}</p><form><p>Your name</p><input></form><p>Last.</p></article>") == f"{P.strip()}\nLast."


def test_smoothing_keeps_the_order_of_two_lines():
    x = op.smooth(op.np.array([100.0, 10.0]))
    assert x[0] > x[1] and op.np.allclose(op.smooth(op.np.full(9, 4.0)), 4.0)


def test_broken_markup():
    assert text(f"<article><p><b>{P}<br><p>next<p>last</article></nav></div>") == f"{P.strip()}\nnext\nlast"
    assert text(f"<article><p>{P}") == P.strip()
    assert op.main_text(f"<p>{P}")[0] == P.strip()
    for junk in ("<", "<>", "<a", "&", "&#x;", "<!--", "<![CDATA[", "</", "<script>", "<p " * 1000, "plain text only"):
        op.main_text(junk)
    assert op.main_text("plain text only")[0] == "plain text only"


def test_hidden_parts_and_state_classes():
    body = f"<div hidden>gone</div><div style='display: none'>gone</div><article class='has-sidebar'><p>{P}</p><p aria-hidden='true'>gone</p></article>"
    assert text(body) == P.strip()


def test_defined_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<html></html>"), (3, "u", page(f"<article><p>{P}</p></article>")), (4, "u", page("<article>" + f"<p>{P}</p>" * 3000 + "</article>")), (None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["html"]): r for r in op.extract(df).collect()}
    assert got[(1, None)]["text"] == got[(2, "")]["text"] == got[(3, "<html></html>")]["text"] == ""
    assert got[(4, rows[4][2])]["text"] == "\n".join([P.strip()] * 3000) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert op.extract(df.limit(0)).count() == 0
    clash = op.extract(df.withColumn("text", F.lit("old")).withColumn("lines_seen", F.lit("old")))
    assert sorted(r["text"] for r in clash.collect()) == sorted(r["text"] for r in got.values())


def test_given_pages_against_their_article(spark):
    """The given pages hold their text in one article element; a plain reading of it is the truth."""
    for r in op.op8_html_text(spark, SF01).join(spark.read.parquet(f"{SF01}/pages.parquet").select("page_id", "html"), "page_id").collect():
        a = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1)>", "\0", a).replace("<br>", " ")).split("\0")
        assert r["text"] == "\n".join(x for x in (" ".join(H.unescape(b).split()) for b in blocks) if x)
