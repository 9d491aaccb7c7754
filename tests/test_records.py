"""Record building on small pages with known results."""

import pytest

from docrecords import Spec, build_records

HEADINGS = {"lvl0": "h1", "lvl1": "h2", "lvl2": "h3", "lvl3": "h4", "lvl4": "h5", "lvl5": "h6", "content": "p"}
FOUR = {"lvl0": "h1", "lvl1": "h2", "lvl2": "h3", "content": "p"}


def run(spark, html, url=None, **config):
    spec = Spec.of({"index_uid": "t", "start_urls": ["test"], "selectors": HEADINGS, **config})
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string").coalesce(1)
    return build_records(pages, spec).orderBy("weight.position").collect()


def levels(row, n=3):
    return tuple(row.hierarchy)[:n]


def test_headings_fill_down(spark):
    rows = run(spark, "<html><body><h1>Foo</h1><h2>Bar</h2><h3>Baz</h3></body></html>")
    assert [levels(r) for r in rows] == [("Foo", None, None), ("Foo", "Bar", None), ("Foo", "Bar", "Baz")]
    assert [r.type for r in rows] == ["lvl0", "lvl1", "lvl2"]
    assert [tuple(r.weight) for r in rows] == [(0, 100, 0), (0, 90, 1), (0, 80, 2)]
    assert [tuple(r.hierarchy_radio)[:3] for r in rows] == [("Foo", None, None), (None, "Bar", None), (None, None, "Baz")]
    # fixed values: ids that every implementation gives this page
    assert [r.objectID for r in rows] == [
        "9d2d056ef5f45585b2ed5121e6487c8e04c63da4",
        "5f6c974da7435f903a7f3e8d441b42107c5ddb23",
        "71980d31d18995da99751933a79075e35b1a68bc",
    ]


def test_content_before_headings_and_unicode(spark):
    rows = run(spark, "<p>Sow ☀ early – até já</p><h1>Garden</h1><h2>Beds</h2>")
    assert [(r.type, r.content, levels(r, 2)) for r in rows] == [
        ("content", "Sow ☀ early – até já", (None, None)), ("lvl0", None, ("Garden", None)), ("lvl1", None, ("Garden", "Beds")),
    ]
    assert tuple(rows[0].hierarchy_radio) == (None,) * 7


def test_wrappers_keep_document_order(spark):
    html = """<main><section><h1>Garden</h1></section><section><p>soil</p><aside><h2>Beds</h2></aside></section></main>
    <p>compost</p><table><tr><td><h3>Rows</h3><p>peas</p></td></tr></table>"""
    rows = run(spark, html)
    assert [(r.type, r.content) for r in rows] == [
        ("lvl0", None), ("content", "soil"), ("lvl1", None), ("content", "compost"), ("lvl2", None), ("content", "peas"),
    ]
    assert levels(rows[5]) == ("Garden", "Beds", "Rows")


def test_heading_with_inner_elements(spark):
    rows = run(spark, '<section><h1><code id="k">Trowel</code><br><i></i></h1><p>steel</p></section>')
    assert levels(rows[0])[0] == "Trowel" and levels(rows[1])[0] == "Trowel"


def test_text_nodes_by_xpath(spark):
    html = """<article>before<h1>Garden</h1> <em>not this</em> peas and beans, <h2>Beds</h2>carrots<br> <br></article>"""
    loose = {"selector": "//article/text()[normalize-space()]", "type": "xpath"}
    rows = run(spark, html, selectors={"lvl0": "h1", "lvl1": "h2", "content": loose}, strip_chars=",")
    assert [(r.content, levels(r, 2)) for r in rows if r.type == "content"] == [
        ("before", (None, None)), ("peas and beans", ("Garden", None)), ("carrots", ("Garden", "Beds")),
    ]


SETS = {"plants": FOUR, "tools": {"lvl0": "h1"}}
PUNCT = "<h1>.Garden;</h1><h2>!Beds.</h2><h3>,Rows!</h3><p>,peas,</p>"
RULES = [
    {"url": "http://garden.example/tools/", "selectors_key": "tools"},
    {"url": "http://garden.example/plants/", "selectors_key": "plants"},
]


def test_selector_sets(spark):
    rows = run(spark, PUNCT, "http://garden.example/plants/pea", selectors=SETS, start_urls=RULES)
    assert levels(rows[3]) == ("Garden", "!Beds", "Rows!") and rows[3].content == "peas"
    rows = run(spark, PUNCT, "http://garden.example/tools/rake", selectors=SETS, start_urls=RULES)
    assert [(r.type, levels(r)[0]) for r in rows] == [("lvl0", "Garden")]


def test_a_page_without_selectors_is_an_error(spark):
    with pytest.raises(Exception, match="no selectors for http://garden.example/other"):
        run(spark, PUNCT, "http://garden.example/other", selectors=SETS, start_urls=RULES)


def test_minimum_level_by_set(spark):
    def types(path, **levels_by_set):
        return [r.type for r in run(spark, PUNCT, f"http://garden.example/{path}/x", selectors=SETS, start_urls=RULES, min_indexed_level=levels_by_set)]

    assert types("plants", plants=2) == ["lvl2", "content"]
    assert types("plants", plants=1, default=3) == ["lvl1", "lvl2", "content"]
    with pytest.raises(Exception, match="no minimum level"):
        types("tools", plants=1)


def test_attributes_and_values_as_texts(spark):
    html = '<title>Pea</title><h1 title="Sugar pea.">x</h1><p>a</p><a href="/one">1</a><a href="/two">2</a><h1 title="Snow pea">y</h1>'
    by_attribute = {"selector": "//h1/@title", "type": "xpath"}
    rows = run(spark, html, selectors={"lvl0": by_attribute, "content": "p", "links": {"selector": "//a/@href", "type": "xpath"}})
    assert [(r.type, levels(r, 1)) for r in rows] == [("lvl0", ("Sugar pea",)), ("content", ("Sugar pea",)), ("lvl0", ("Snow pea",))]
    assert {r.extras["links"] for r in rows} == {'"/one /two"'}
    title = {"selector": "string(//title)", "type": "xpath", "global": True}
    rows = run(spark, html, selectors={"lvl0": title, "content": "p"})
    assert [(r.type, levels(r, 1), r.content) for r in rows] == [("content", ("Pea",), "a")]


def test_many_alternatives(spark):
    css = ", ".join([f".c{i} > .d{i}" for i in range(40)] + ["div > p"])
    xpath = " | ".join([f"//*[contains(@class, 'c{i}') and not(@id = 'x{i}')]" for i in range(40)] + ["//div/p"])
    html = '<div><h1>A</h1><p>one</p></div><b class="c7"><i class="d7">two</i></b>'
    assert [r.content for r in run(spark, html, selectors={"lvl0": "h1", "content": css})] == [None, "one", "two"]
    rows = run(spark, html, selectors={"lvl0": "h1", "content": {"selector": xpath, "type": "xpath"}})
    assert [r.content for r in rows] == [None, "one", "two"]


def test_keep_tags(spark):
    rows = run(spark, "<h1><kbd>Ctrl</kbd> &lt;u&gt;</h1>", keep_tags=["kbd"])
    assert levels(rows[0])[0] == "<kbd>Ctrl</kbd>  &lt;u&gt;"


def test_stop_content(spark):
    html = "<h1>Garden</h1><p>This bed is closed for winter</p>"
    assert run(spark, html, stop_content="closed for winter") == []
    assert len(run(spark, html, stop_content="closed for summer")) == 2


@pytest.mark.parametrize("inner", ["Beds<sup class='note'>3</sup>", "<sup class='x note'>3</sup>Beds"])
def test_exclude_keeps_tail(spark, inner):
    rows = run(spark, f"<h1>Garden</h1><h2>{inner}</h2>", selectors_exclude=[".note"])
    assert [levels(r, 2) for r in rows] == [("Garden", None), ("Garden", "Beds")]


def test_exclude_joins_neighbouring_text(spark):
    rows = run(spark, '<body><h1>Foo<a class="x"><b>y</b></a>Bar</h1></body>', selectors_exclude=["h1 > .x"])
    assert levels(rows[0])[0] == "FooBar"


def test_global_levels(spark):
    html = "<body><p>text</p><h2>Bar</h2><h3>Baz</h3><h1>Foo</h1><h1>Foo</h1></body>"
    one = {**FOUR, "lvl0": {"selector": "h1", "global": True}}
    rows = run(spark, html, selectors=one)
    assert [levels(r) for r in rows] == [("Foo Foo", None, None), ("Foo Foo", "Bar", None), ("Foo Foo", "Bar", "Baz")]
    two = {**one, "lvl1": {"selector": "h2", "global": "true"}}
    rows = run(spark, html, selectors=two)
    assert levels(rows[0]) == ("Foo Foo", "Bar", None) and rows[0].content == "text"


@pytest.mark.parametrize(
    "selector, value",
    [
        (".test", '"ok"'),
        ({"selector": "//*[@class='test']", "type": "xpath"}, '"ok"'),
        ({"selector": "count(//*[@class='test'])", "type": "xpath"}, "1.0"),
        ({"selector": "string(//h2)", "type": "xpath"}, '"Bar"'),
        (".absent", "null"),
    ],
)
def test_extra_attributes_from_selectors(spark, selector, value):
    html = '<body><p>text</p><h2>Bar</h2><span class="test">ok</span></body>'
    rows = run(spark, html, selectors={**FOUR, "extra_attr": selector})
    assert {r.extras["extra_attr"] for r in rows} == {value} or value == "null"
    assert rows[0].extras["extra_attr"] == value and levels(rows[0]) == (None, None, None)


def test_defaults(spark):
    def lvl0(html, sel, **kw):
        return [levels(r) + (r.content,) for r in run(spark, html, selectors={**FOUR, "lvl0": sel}, **kw)]

    sel = {"selector": "h1", "default_value": "Doc"}
    assert lvl0("<p>text</p><h2>Bar</h2>", sel) == [("Doc", None, None, "text"), ("Doc", "Bar", None, None)]
    glob = {**sel, "global": True}
    assert lvl0("<p>text</p>", glob) == [("Doc", None, None, "text")]
    assert lvl0("<h1>Foo</h1><p>text</p>", glob) == [("Foo", None, None, "text")]
    empty = lvl0("<h1></h1><p>text</p>git<h2>Bar</h2><h3>Baz</h3>", sel)
    assert len(empty) == 4 and empty[0] == ("Doc", None, None, None)
    assert len(lvl0("<p>text</p><h2>Bar</h2><h3>Baz</h3><h1></h1>", glob)) == 3
    rows = run(spark, "<h1>Foo</h1><h2>Bar</h2>", selectors={**FOUR, "content": {"selector": "p", "default_value": "Doc"}})
    assert [r.content for r in rows] == ["Doc", "Doc"]


@pytest.mark.parametrize(
    "meta, name, value",
    [
        ("content='12'", "extra", "12"),
        ("""value='["ruby"]'""", "extra", None),
        ("""content='["ruby","rails"]'""", "extra", '["ruby","rails"]'),
        ("content='1.2.3'", "version", '"1.2.3"'),
        ("content='1.0'", "version", '"1.0"'),
        ("content='1.10'", "version", '"1.1"'),
        ("content='12'", "version", '"12"'),
        ("""content='"ok"'""", "string", '"ok"'),
        ("content='0'", "zero", '"0"'),
        ("content='[]'", "list", '"[]"'),
        ("content='plain text'", "plain", '"plain text"'),
        ("content=''", "nothing", None),
    ],
)
def test_meta(spark, meta, name, value):
    html = f"<html><header><meta name='pre:{name}' {meta}></header><body><h1>Foo</h1><p>t</p></body></html>"
    rows = run(spark, html, meta_prefix="pre:")
    assert len(rows) == 2
    assert [r.extras.get(name) for r in rows] == [value, value]


@pytest.mark.parametrize(
    "html, anchor",
    [
        ('<h2 name="bar">Bar</h2>', "bar"),
        ('<h2 id="bar">Bar</h2>', "bar"),
        ('<h2><a href="#" name="bar">Bar</a><span></span></h2>', "bar"),
        ('<div><a id="bar"></a><div><div><h2>Bar</h2></div></div></div>', "bar"),
        ("<h1>Foo</h1><h2>Bar</h2>", None),
        ('<h2 id="own"><a name="inner">x</a></h2>', "own"),
        ('<h2><a name="one">x</a><a id="two">y</a></h2>', "two"),
        ('<h2 name="" id="z">x</h2>', ""),
        ('<div id="up"><p>x</p><h2>Bar</h2></div>', "up"),
        ('<div id="up"><p id="before">x</p><h2>Bar</h2><p id="after"></p></div>', "before"),
        ('<div><div><a id="deep"></a></div><h2>Bar</h2></div>', None),
    ],
)
def test_anchor(spark, html, anchor):
    rows = [r for r in run(spark, f"<body>{html}</body>", "http://a.b/c") if r.type == "lvl1"]
    assert rows[0].anchor == anchor
    assert rows[0].url == "http://a.b/c" + ("" if anchor is None else f"#{anchor}")


def test_anchor_of_content_comes_from_headings(spark):
    rows = run(spark, '<h1 id="a">A</h1><p id="p">x</p><h2>B</h2><p>y</p>', "http://a.b/c")
    # the second heading finds the paragraph's id before it
    assert [r.anchor for r in rows] == ["a", "a", "p", "p"]


@pytest.mark.parametrize(
    "rank, url, want",
    [
        (3, "https://garden.example/seeds", 3),
        (3, "https://garden.example/seeds/tomato", 3),
        (-2, "https://garden.example/seeds/kale", -2),
        (7, "https://shed.example/", 0),
    ],
)
def test_page_rank_and_tags(spark, rank, url, want):
    rules = [{"url": "https://garden.example/seeds", "page_rank": rank, "tags": ["seeds"]}]
    row = run(spark, "<h1>Sowing</h1>", url, start_urls=rules)[0]
    assert row.weight.page_rank == want
    assert row.tags == (["seeds"] if want else [])


def test_regex_rule_and_extra_attributes(spark):
    rules = [
        {"url": "https://garden.example/.*", "tags": ["garden"]},
        {"url": "https://garden.example/seeds", "extra_attributes": {"season": 2, "beds": ["north"]}},
    ]
    row = run(spark, "<h1>Sowing</h1>", "https://garden.example/seeds/tomato", start_urls=rules)[0]
    assert row.tags == ["garden"]
    assert row.extras == {"season": "2", "beds": '["north"]'}


def test_strip_chars(spark):
    rows = run(spark, PUNCT, selectors=FOUR, strip_chars=",.")
    assert levels(rows[3]) == ("Garden;", "!Beds", "Rows!") and rows[3].content == "peas"
    rows = run(spark, PUNCT, selectors={**FOUR, "lvl1": {"selector": "h2", "strip_chars": "!"}}, strip_chars=",.")
    assert levels(rows[3]) == ("Garden;", "Beds.", "Rows!") and rows[3].content == "peas"


def test_min_level_and_content_only(spark):
    html = "<h1>Foo</h1><h2>Bar</h2><h3>Baz</h3><p>text</p>"
    assert [r.type for r in run(spark, html, min_indexed_level=2)] == ["lvl2", "content"]
    rows = run(spark, html, only_content_level=True)
    assert [(r.type, levels(r), r.weight.position) for r in rows] == [("content", ("Foo", "Bar", "Baz"), 3)]


def test_empty_selector(spark):
    html = "<h1>Foo</h1><h2>Bar</h2><h3>Baz</h3><p>t</p>"
    rows = run(spark, html, selectors={**FOUR, "lvl0": ""})
    assert len(rows) == 3 and levels(rows[0]) == (None, "Bar", None)
    rows = run(spark, html, selectors={**FOUR, "lvl0": {"selector": "", "default_value": "Documentation"}})
    assert len(rows) == 3 and levels(rows[0])[0] == "Documentation"


def test_level_attributes(spark):
    plant = {
        "selector": "li.plant",
        "attributes": {"name": "b", "months": {"selector": "//li/i", "type": "xpath"}, "height": {"selector": "./span[2]", "type": "xpath"}},
    }
    html = "<h1>Garden</h1><ul><li class=plant><b>Pea</b><span>green</span><span>2 m</span></li></ul><p>Sow.</p><li><i>May</i></li>"
    rows = run(spark, html, selectors={"lvl0": "h1", "lvl1": plant, "content": "p"})
    assert [r.type for r in rows] == ["lvl0", "lvl1", "content"] and rows[0].level_attrs == {}
    want = {"lvl1": {"name": "Pea", "months": "May", "height": "2 m"}}
    assert rows[1].level_attrs == want and rows[2].level_attrs == want
    assert rows[2].content == "Sow" and levels(rows[2])[0] == "Garden"


def test_attributes_of_content_are_ignored(spark):
    content = {"selector": "p", "attributes": {"bold": "b"}}
    rows = run(spark, "<h1>A</h1><p>x <b>y</b></p>", selectors={"lvl0": "h1", "content": content})
    assert [(r.type, r.content) for r in rows] == [("lvl0", None), ("content", "x  y")]


def test_xpath_levels(spark):
    html = "<nav><b>Plants</b><ol><li>Pea<li id=here>Bean</ol></nav><h1>Garden</h1><h3>Rows</h3><p>Dig.</p>"
    rows = run(spark, html, selectors={**FOUR, "lvl0": {"selector": "//p/preceding-sibling::h1", "type": "xpath"}})
    assert [(r.type, levels(r)) for r in rows] == [
        ("lvl0", ("Garden", None, None)), ("lvl2", ("Garden", None, "Rows")), ("content", ("Garden", None, "Rows")),
    ]
    up = {"selector": "//*[@id='here']/ancestor::nav/b", "type": "xpath", "global": True}
    rows = run(spark, html, selectors={"lvl0": up, "lvl1": "#here", "lvl2": "h3", "content": "p"})
    assert [levels(r) for r in rows] == [("Plants", "Bean", None), ("Plants", "Bean", "Rows"), ("Plants", "Bean", "Rows")]


def test_overlapping_levels_prefer_the_shallowest(spark):
    html = '<body><h2 class="t">A</h2><div class="c"><p>x</p></div><h2>B</h2></body>'
    rows = run(spark, html, selectors={"lvl0": "body > .t", "lvl1": "h2", "content": "div p, .c"})
    assert [(r.type, r.content) for r in rows] == [("lvl0", None), ("content", "x"), ("content", "x"), ("lvl1", None)]


def test_url_variables(spark):
    rules = [
        {
            "url": "http://t.com/doc/(?P<version>.*?)/(?P<lang>.*?)/",
            "variables": {"version": ["1.0", "1.1"], "lang": ["en", "fr"]},
        }
    ]
    row = run(spark, '<h1 id="x">Foo</h1>', "http://t.com/doc/1.1/fr/page", start_urls=rules)[0]
    assert row.extras == {"version": '"1.1"', "lang": '"fr"'}
    assert row.url == "http://t.com/doc/1.1/fr/page#x"
    assert row.url_without_variables == "http://t.com/doc///page#x"
    assert row.url_without_anchor == "http://t.com/doc/1.1/fr/page" and row.no_variables is False


def test_anchor_not_added_for_rendered_anchor_pages(spark):
    row = run(spark, '<h1 id="x">Foo</h1>', "http://t.com/#/a", js_render=True, use_anchors=True)[0]
    assert (row.url, row.anchor, row.no_variables) == ("http://t.com/#/a", "x", True)


def test_default_of_a_level_after_a_gap(spark):
    selectors = {"lvl0": "h1", "lvl2": {"selector": "h3", "default_value": "Two"}, "content": "p"}
    rows = run(spark, "<h1>A</h1><h3>C</h3><p>x</p>", selectors=selectors)
    # levels after the first missing one match nothing, but their default is filled in
    assert [(r.type, levels(r)) for r in rows] == [("lvl0", ("A", None, "Two")), ("content", ("A", None, "Two"))]
    assert rows[0].hierarchy_radio.lvl0 == "A" and rows[0].hierarchy_radio.lvl2 is None


def test_content_without_levels(spark):
    rows = run(spark, "<h1>A</h1><p>x</p>", selectors={"default": {"content": "p"}})
    assert [(r.type, levels(r), r.content) for r in rows] == [("content", (None, None, None), "x")]
