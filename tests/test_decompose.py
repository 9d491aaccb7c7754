"""Page decomposition: shape of the node table, recovery rules, excluded parts."""

import xml.dom.minidom

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docrecords.operators.css import css_column, parse_css
from docrecords.operators.decompose import _Columns, _xml, decompose, node_rows, page_links, parse_page
from docrecords.operators.select import select_nids
from docrecords.spec import Selector


def tree(html, exclude=(), keep=()):
    """Nested form of a page: elements as ``tag(...)``, text in quotes."""
    cols = _Columns()
    parse_page(html, cols, [p for css in exclude for p in parse_css(css)], frozenset(keep))

    def show(nid):
        if cols.tag[nid] is None:
            return repr(cols.frag[cols.lo[nid]])
        kids = [n for n in range(len(cols.parent)) if cols.parent[n] == nid]
        return f"{cols.tag[nid]}({' '.join(map(show, kids))})"

    return show(0)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<p>b", "html(body(p('a') p('b')))"),
        ("<p><b>a<br><p>b", "html(body(p(b('a' br())) p('b')))"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "html(body(ul(li('a') li('b' ul(li('c'))) li('d'))))"),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", "html(body(table(tr(td('a') td('b')) tr(th('c'))) 'd'))"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "html(body(dl(dt('a') dd('b') dt('c'))))"),
        ("<div>a</p>b</div>", "html(body(div('ab')))"),
        ("<div><b>a</div>b", "html(body(div(b('a')) 'b'))"),
        ("<div><p>a</b></div>", "html(body(div(p('a'))))"),
        ("<a>x<a>y</a>", "html(body(a('x') a('y')))"),
        ("<h1>a<h2>b", "html(body(h1('a') h2('b')))"),
        ("<br/><div/>x", "html(body(br() div() 'x'))"),
        ("<script>var t='</p>';</script><p>a", "html(head(script(\"var t='</p>';\")) body(p('a')))"),
        ("<title>t</title><p>a</body></html> ", "html(head(title('t')) body(p('a') ' '))"),
        ("<html><head><meta charset=x></head> <body class=y>a</body></html>", "html(head(meta()) body('a'))"),
        ("text", "html(body(p('text')))"),
        ("a &lt; b < c &amp; &eacute;", "html(body(p('a < b < c & é')))"),
        ("<p>&amp &copy; &nope; &#65 &#x42; &#0; &#x110000; &#99999999999; &apos;", "html(body(p(\"&amp © &nope; A B    '\")))"),
        ('<p title="&amp &lt;">&', "html(body(p('&')))"),
        ("<div>a<!-- c -->b</div>", "html(body(div('a' 'b')))"),
        ("<!DOCTYPE html><?pi ?><div>a</div>", "html(body(div('a')))"),
        ("<select><option>a<option>b</select>", "html(body(select(option('a') option('b'))))"),
        ("<!-- open <p>a", "html()"),
        ("", "html()"),
    ],
)
def test_recovery(html, want):
    assert tree(html) == want


@pytest.mark.parametrize(
    "css, want",
    [
        (".x", "html(body(div('ac') p('d')))"),
        ("div > b", "html(body(div('ac') p('d')))"),
        ("body b + p, div b", "html(body(div('ac') p('d')))"),
        ("div ~ p", "html(body(div('a' b('b' i('i')) 'c')))"),
        ("#none, [data-a], p:first-child", "html(body(div('a' b('b' i('i')) 'c') p('d')))"),
        ("body > :nth-child(2)", "html(body(div('a' b('b' i('i')) 'c')))"),
        ("div b:not(.y)", "html(body(div('ac') p('d')))"),
        ("i", "html(body(div('a' b('b') 'c') p('d')))"),
    ],
)
def test_exclude(css, want):
    html = '<div>a<b class="w x">b<i>i</i></b>c</div><p>d</p>'
    assert tree(html, [css]) == want


LATE = [
    ("p:last-child", "html(body(p('1') p('2') ul(li('3') li('4')) p))"),
    ("li:last-child, p:empty", "html(body(p('1') p('2') ul(li('3')) p('5')))"),
    ("p:contains(2)", "html(body(p('1') ul(li('3') li('4')) p p('5')))"),
    ("ul:not(:only-of-type)", "html(body(p('1') p('2') ul(li('3') li('4')) p p('5')))"),
    ("p:nth-last-of-type(-n+3), li:only-child", "html(body(p('1') ul(li('3') li('4'))))"),
]


@pytest.mark.parametrize("css, want", LATE)
def test_exclude_by_what_follows(spark, css, want):
    pages = spark.createDataFrame([(1, "<p>1</p><p>2</p><ul><li>3<li>4</ul><p></p><p>5</p>")], "page_id long, html string").coalesce(1)
    row = decompose(pages, exclude=[css]).first()

    def write(nid):
        node = row.nodes[nid]
        if node.tag is None:
            return f"'{row.frags[node.lo].s}'"
        inner = " ".join(write(n.nid) for n in row.nodes if n.parent == nid)
        return f"{node.tag}({inner})" if inner else node.tag

    assert write(0) == want


PIECES = st.lists(
    st.sampled_from(
        ["<p>", "</p>", "<b>", "</b>", "<div id='a'>", "</div>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>",
         "<br>", "<a name=x href=/y>", "</a>", "<!-- c -->", "<script>", "</script>", "text", " ", "&amp;", "<", ">", "\x0b",
         "<o:p 1a='2' x:y=z nid=5>", "<h1>", "</h1>", "<html>", "<body>", "<head>", "<title>", "</title>", "\U0001f600", "<i x='1"]
    ),
    max_size=40,
)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_invariants_on_broken_pages(pieces):
    cols = _Columns()
    parse_page("".join(pieces), cols, [], frozenset())
    n = len(cols.parent)
    assert cols.parent[0] == -1 and cols.last[0] == n - 1
    anchored = [i for i in range(n) if cols.attrs[i] and ("name" in cols.attrs[i] or "id" in cols.attrs[i])]
    for i in range(1, n):
        up = cols.parent[i]
        assert 0 <= up < i <= cols.last[i] <= cols.last[up]
        inside = [f for f in range(n) if cols.tag[f] is None and i <= f <= cols.last[i]]
        assert cols.n[i] == len(inside)
        assert not inside or cols.lo[i] == cols.lo[inside[0]]
        if cols.tag[i] is None:
            continue
        # nearest anchor before the node among siblings of the node and of its ancestors, or the ancestors themselves
        around = [c for c in anchored if c < i and (cols.parent[c] == -1 or cols.last[cols.parent[c]] >= i)]
        assert cols.anchor_before[i] == (max(around) if around else None)
        below = [c for c in anchored if i <= c <= cols.last[i]]
        assert cols.anchor_in[i] == (max(below) if below else None)
    for marked in (False, True):
        xml.dom.minidom.parseString(_xml(cols, 0, n, 0, marked).encode("utf-8", "surrogatepass"))


def test_excluding_equals_removing_rows(spark):
    html = '<body><nav><a href="/x">m</a></nav><h1>T</h1><div class="ad"><p>no</p></div><p>yes</p></body>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string").coalesce(1)
    cut = node_rows(decompose(pages, exclude=["nav", ".ad"]), "page_id")
    full = node_rows(decompose(pages), "page_id")
    gone = full.filter(F.col("tag").eqNullSafe("nav") | F.coalesce(F.col("attrs")["class"] == "ad", F.lit(False)))
    gone = gone.select(F.col("nid").alias("lo_nid"), F.col("last").alias("hi_nid"))
    rest = full.join(gone, F.col("nid").between(F.col("lo_nid"), F.col("hi_nid")), "left_anti")
    names = lambda df: [r.tag for r in df.orderBy("nid").collect()]
    assert names(cut) == names(rest) == ["html", "body", "h1", None, "p", None]


SELECTORS = {
    "p": [6, 8, 12, 14], ".ad": [5], "div p": [6, 8], "div > p": [6, 8], "h1 + p": [12], "h1 ~ p": [12, 14], "[href]": [21, 23],
    "a[href^='/x']": [21], "#m, p.y": [5, 6, 14], "p:first-child": [6], "p:last-child": [8], "li:not(.y)": [19],
    "p:nth-of-type(2n+1)": [6, 12], "p:nth-of-type(even)": [8, 14], "p:last-of-type": [8, 14], "li:nth-last-child(1)": [19],
    "a:nth-last-of-type(2)": [21], "p:not(.y, :last-child)": [12], ":is(h1, li).y": [17], "h1:only-of-type": [10], "p:contains(4)": [14],
    r".md\:z": [14], "body > :nth-child(-n+2)": [5, 10], "p:empty": [],
}


def test_selectors(spark):
    html = """<title>x</title><div id="m" class="ad b"><p class="y">1</p><p>2</p></div><h1>t</h1><p>3</p><p class="md:z y">4</p><ul><li class="y">5<li>6</ul><a href="/xy">7</a><a href="/z">8</a>"""
    pages = spark.createDataFrame([(1, html)], "page_id long, html string").coalesce(1)
    row = decompose(pages, css=list(SELECTORS))
    got = row.first()
    by_css = {css: got[css_column(css)] for css in SELECTORS}
    assert by_css == SELECTORS
    for css in SELECTORS:
        chosen = row.select(select_nids(Selector(css)).alias("n")).first().n
        assert chosen == SELECTORS[css], css


def test_long_names_stay_apart(spark):
    one, two = "x" * 300, "x" * 299 + "y"
    pages = spark.createDataFrame([(1, f"<p><{one}>1</{one}><{two}>2</{two}></p>")], "page_id long, html string").coalesce(1)
    row = decompose(pages, xml=True)
    got = [row.select(select_nids(Selector(f"//{n}", type="xpath")).alias("n"), "nodes").first() for n in (one, two)]
    assert [[r.nodes[i].tag for i in r.n] for r in got] == [[one], [two]]


def test_links(spark):
    html = """<base href="/z"><a href="/x?a=1&amp;b=2">1</a><a href="y">2</a><area href="//c.d/e"><iframe src="#f"></iframe>
    <img src="no.png"><a>none</a><a href="/x?a=1&amp;b=2">again</a>"""
    pages = spark.createDataFrame([("http://a.b/c/d", html)], "url string, html string").coalesce(1)
    got = [r.dst_url for r in page_links(decompose(pages)).collect()]
    assert got == ["http://a.b/x?a=1&b=2", "http://a.b/y", "http://c.d/e", "http://a.b/z#f"]
    plain = pages.withColumn("html", F.replace("html", F.lit('<base href="/z">'), F.lit("")))
    assert [r.dst_url for r in page_links(decompose(plain)).collect()][1::2] == ["http://a.b/c/y", "http://a.b/c/d#f"]
