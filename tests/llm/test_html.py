import html as entities
import re

from conftest import SF001
from tsfolds.llm import html
from tsfolds.llm import queries as Q


def plain(page):
    """Main text of the generated pages: the blocks of the one article element."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    if not body:
        return ""
    blocks = re.split(r"</?(?:p|h1|article)>", re.sub(r"</?b>", "", body.group(1)).replace("<br>", " "))
    return "\n".join(filter(None, (" ".join(entities.unescape(b).split()) for b in blocks)))


def test_query(spark):
    got = {r.page_id: r for r in Q.op10_host_paths(spark, SF001).collect()}
    pages = spark.read.parquet(f"{SF001}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert r.url == p.url and r.text == plain(p.html) and r.n_chars == len(r.text)


def page(main, extra="", cls="content-12"):
    return (
        f"<html><head><title>t</title><style>p{{a>b}}</style></head><body><div class='site-header'><h2>Site</h2></div><nav><a href=x>Home</a></nav>"
        f"<div id=wrap><div class='{cls}'>{main}</div><div class=sidebar><p>Side words that are not wanted here at all</p></div>{extra}</div>"
        "<div class='cookie-notice'><p>We use cookies on this site and more</p></div><footer><p>Foot &copy;</p></footer></body></html>"
    )


def test_consensus_and_noise(spark):
    long = "<h1>Head &amp; tail</h1><p>One  two\n three<br>four.</p><script>if (a<b) '</p>'</script><p>Five &lt;six&gt; <a href='/'>linked</a>.</p><!-- <p>no</p> -->"
    talk = "<div class=comments><p>" + "I say this and that. " * 60 + "</p></div>"
    rows = [(i, f"http://a.example/{i}", page(long * 3, talk)) for i in range(6)]
    rows += [(10, "http://A.example:80/x", page("<p>Tiny.</p>", "<div class=extra><p>" + "Words of another box. " * 9 + "</p></div>", cls="content-7"))]
    rows += [(11, "http://b.example/", "<p>Bare text"), (12, None, None), (13, "nonsense", ""), (14, "http://a.example/z", "<body><main>Only <b>this"), (15, "http://c.example", "a < b & c &am")]
    rows += [(16, "http://d.example", "<div><div><a href='x>y'>" * 2000 + "deep" + "<p>x</p>" * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as winner", "3 as rest", "'t' as text")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    block = "Head & tail\nOne two three four.\nFive <six> linked."
    assert got[0] == got[5] == "\n".join([block] * 3)
    assert got[10] == "Tiny."  # by the host's path, though another box of the page is longer
    assert got[11] == "Bare text" and got[12] == got[13] == "" and got[14] == "Only this" and got[15] == "a < b & c &am"
    assert html.main_text(df.limit(0)).collect() == []


def test_odd_markup_takes_linear_time():
    import time

    shapes = ["<a href=\"", "<div x='", "<", "<!--", "<!x ", "<a<b", "<a b='\"", "</x ", "<p class=ad>x", "<div class='row wide'>x", "<ul><li class=ad>", "</section><div>", "<script>", "<a \"'>", "&am", "<a x=\">'"]
    for shape in shapes:
        took = []
        for n in (30_000, 120_000):
            t = time.process_time()
            nodes, blocks = html.parse(shape * (n // len(shape)))
            html.extract(nodes, blocks, html.best(html.votes(nodes)))
            took.append(time.process_time() - t)
        assert took[1] < 10 * max(took[0], 0.05), (shape, took)


def regex_tokens(page):
    """The markup by one expression, which takes square time on odd pages."""
    token = re.compile(
        r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|xmp|template|select)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
        r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|<[/a-zA-Z!?][^<]*\Z",
        re.S | re.I,
    )
    return [(m.start(), m.end(), m.group(3).lower() if m.group(3) else None, bool(m.group(2)), m.group(4)) for m in token.finditer(page)]


def test_markup_against_one_expression():
    import random

    rnd = random.Random(6)
    parts = ["<", ">", "a", "/", " ", "'", "\"", "<div", "<p>", "</p>", "<!--", "-->", "<!", "<script>", "</script >", "=", "x", "<a href='b'>", "é", "<br/>", "<SELECT a=1>", "</select>", "?"]
    for _ in range(30_000):
        page = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))
        assert list(html._Tags(page)) == regex_tokens(page), page


def test_mathematics_is_text():
    nodes, blocks = html.parse("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><svg><title>no</title><text>Yes</text></svg></article>")
    assert html.extract(nodes, blocks, html.best(html.votes(nodes))) == "Let x=2 hold.\nYes"


def test_attributes_of_every_element():
    def text(body):
        nodes, blocks = html.parse(f"<body><div class=x>{body}</div></body>")
        return html.extract(nodes, blocks, html.digest("/root/body/div.x")).split("\n")

    assert text("<p>One.<p class=ad>Buy.<p>Two <span class='sponsored'>paid <span>and</span> more</span>three.</p><p hidden>No.</p>Four") == ["One.", "Two three.", "Four"]
    assert text("<ol class=thread><li class=comment>I<ul><li>say<li>so</ul><div>here</div><li>Item</ol><p>End") == ["Item", "End"]
    assert text("<h2 class=promo>Now <b>x</b></h2><h3>Head</h3><p>A <em class=ad>b<p>C</p><dl><dt class=ad>d<dd>E</dl>") == ["Head", "A", "C", "E"]
    assert text("<article class=comment><p>I say.</p></article><article class='post share'><p>Post.</p></article>") == ["Post."]
    assert text("<p class=cookie-notice>We use</p><a href='?id=comments' style='overflow:hidden'>Link</a><img class=ad><p>End<li class=ad>x") == ["Link", "End"]


def test_long_class_lists_have_their_own_paths():
    names = [f"{a}{b}utility" for a in "abcdef" for b in "xyz"]
    nodes, _ = html.parse("".join(f"<div class='{' '.join([*names, last])}'>text</div>" for last in ("zmain", "zside")))
    assert len({n.path for n in nodes}) == 3
