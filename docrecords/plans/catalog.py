"""Example queries: one or more per operator, over the whole input tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.functions import text as T
from docrecords.functions import urls as U
from docrecords.operators import crawl as C
from docrecords.operators import hierarchy as H
from docrecords.operators import index as I
from docrecords.operators import lookup as L
from docrecords.operators import page_attrs as P
from docrecords.operators import postings as PO
from docrecords.operators import rule_table as RT
from docrecords.operators import url_layout as UL
from docrecords.operators import url_rules as R
from docrecords.operators.decompose import decompose, node_rows, page_links
from docrecords.operators.select import page_text, select_nids, texts_of
from docrecords.plans import crawl as run_plan
from docrecords.plans import samples as S
from docrecords.plans.records import build_records, drop_stop_content, page_attributes, parse_pages
from docrecords.sources.pages import decode_body, decode_pages, spread
from docrecords.sources.sitemap import crawl_sitemaps, sitemap_urls
from docrecords.spec import CONTENT, LEVELS, Selector, Spec
from docrecords.streaming import keyed as KS
from docrecords.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a query writes and reads back."""
    return f"{C.checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- SQL pieces


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_strip(x: str, chars: str = ".,;:§¶") -> str:
    inner = f"trim({x}, {q(T.WHITESPACE)})"
    return f"nullif(trim({inner}, {q(chars)}), '')" if chars else f"nullif({inner}, '')"


def sql_escape(x: str) -> str:
    for char, entity in T.ENTITIES.items():
        if char != "&":
            x = f"replace({x}, {q(char)}, {q(entity)})"
    return x


def sql_decode(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def sql_json(x: str) -> str:
    """ASCII JSON string of a text without control characters."""
    char = (
        "CASE WHEN c = '\"' THEN '\\\"' WHEN c = '\\' THEN '\\\\' WHEN unicode(c) < 127 THEN c "
        "ELSE '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') END"
    )
    return f"'\"' || array_to_string(list_transform(string_split({x}, ''), lambda c: {char}), '') || '\"'"


def sql_object_id(levels: dict[str, str], position: str, url: str) -> str:
    pairs = ", ".join(
        f"CASE WHEN {x} IS NOT NULL THEN '\"{name}\": ' || {sql_json(x)} END" for name, x in levels.items()
    )
    return (
        "sha1('{\"hierarchy_to_hash\": {' || "
        f"array_to_string(list_filter([{pairs}], lambda p: p IS NOT NULL), ', ') || "
        f"'}}, \"position\": ' || {position} || ', \"url\": ' || {sql_json(url)} || '}}')"
    )


def sql_when(cases: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in cases) + f" ELSE {default} END"


PAGE_RANK_SQL = sql_when([(f"regexp_matches(url, '^https?://[^/]+/{lang}/')", str(4 - i)) for i, lang in enumerate(S.LANGS)], "0")
PAGE_TAG_SQL = sql_when([(f"regexp_matches(url, '^https?://[^/]+/{lang}/')", f"'{lang}'") for lang in S.LANGS], "''")

# pages cut into titles and paragraphs by text rules that hold for these tables
PAGE_CTES = f"""
WITH clean AS (
  SELECT page_id, url, regexp_replace(html, '(?s)<script>.*?</script>', '', 'g') AS h FROM pages
), parts AS (
  SELECT page_id, url, regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1) AS title,
         string_split(regexp_extract(h, '(?s)<article>(.*?)(</article>|$)', 1), '<p>')[2:] AS paras
  FROM clean
), matched AS (
  SELECT page_id, url, 0 AS position, 'lvl0' AS type, title AS raw, title FROM parts
  UNION ALL
  SELECT page_id, url, unnest(generate_series(1, len(paras))) AS position, 'content' AS type,
         regexp_replace(split_part(unnest(paras), '</p>', 1), '<[^>]*>', ' ', 'g') AS raw, title
  FROM parts
), cleaned AS (
  SELECT page_id, url, position, type, {sql_escape(sql_strip(sql_decode("raw")))} AS text,
         {sql_escape(sql_strip(sql_decode("title")))} AS lvl0
  FROM matched
), recs AS (
  SELECT page_id, url, CAST(position AS INTEGER) AS position, type, lvl0,
         CASE WHEN type = 'content' THEN text END AS content,
         CASE WHEN type = 'content' THEN 0 ELSE 100 END AS level,
         {PAGE_RANK_SQL} AS page_rank, {PAGE_TAG_SQL} AS tag
  FROM cleaned WHERE type = 'lvl0' OR text IS NOT NULL
), docs AS (
  SELECT page_id, url, position, type, replace(lvl0, '&#x27;', '''') AS hierarchy_lvl0,
         CASE WHEN type = 'lvl0' THEN replace(lvl0, '&#x27;', '''') END AS hierarchy_radio_lvl0,
         replace(content, '&#x27;', '''') AS content, level, page_rank, tag,
         {sql_object_id({"lvl0": "lvl0"}, "position", "url")} AS "objectID"
  FROM recs
)
"""
PAGE_DOC = ["page_id", "url", "position", "type", "hierarchy_lvl0", "hierarchy_radio_lvl0", "content", "level", "page_rank", "objectID"]
PAGE_DOC_SQL = PAGE_CTES + "SELECT " + ", ".join('"objectID"' if c == "objectID" else c for c in PAGE_DOC) + ", tag FROM docs"


def page_doc_columns(docs: DataFrame) -> DataFrame:
    return docs.select(*PAGE_DOC, F.array_join("tags", ",").alias("tag"))


# events as ordered matches with headings carried down
_STATE = "last_value(CASE WHEN lvl <= {k} THEN {{'lvl': lvl, 'text': text, 'anchor': anchor}} END IGNORE NULLS) OVER w AS s{k}"
EVENT_CTES = f"""
WITH ev AS (
  SELECT user_id AS page_id,
         'https://events.example.com/' || CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'fr' END || '/' || user_id AS page_url,
         event_id AS nid, CAST(event_id % 8 AS INTEGER) AS lvl,
         CASE WHEN event_id % 5 <> 0 THEN event_type || ' ' || (event_id % 97) END AS text,
         CASE WHEN event_id % 3 = 0 AND event_id % 8 < 7 THEN 'a' || (event_id % 31) END AS anchor
  FROM events
), states AS (
  SELECT page_id, page_url, nid, lvl, text,
         CAST(row_number() OVER (PARTITION BY page_id ORDER BY nid) - 1 AS INTEGER) AS position,
         {", ".join(_STATE.format(k=k) for k in range(7))}
  FROM ev
  WINDOW w AS (PARTITION BY page_id ORDER BY nid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), filled AS (
  SELECT page_id, page_url, nid, lvl, text, position,
         {", ".join(f"CASE WHEN s{k}.lvl = {k} THEN s{k}.text END AS lvl{k}" for k in range(7))},
         coalesce({", ".join(f"CASE WHEN s{k}.lvl = {k} THEN s{k}.anchor END" for k in range(6, -1, -1))}) AS anchor
  FROM states
)"""


def event_ctes(levels: dict[int, str] | None = None, content_default: str = "NULL", keep: str = "TRUE") -> str:
    """Continue to records: ``levels`` overrides level expressions, ``keep`` filters on lvl."""
    exprs = {k: f"lvl{k}" for k in range(7)} | (levels or {})
    shown = {k: f"lvl{k}" for k in range(7)}
    deepest = "greatest(" + ", ".join(f"CASE WHEN {x} IS NOT NULL THEN {k} END" for k, x in shown.items()) + ")"
    return (
        EVENT_CTES
        + f""", shaped AS (
  SELECT page_id, position, lvl, CASE WHEN lvl = 7 THEN 'content' ELSE 'lvl' || lvl END AS type,
         coalesce(CASE WHEN lvl = 7 THEN text END, {content_default}) AS content,
         {", ".join(f"{x} AS lvl{k}" for k, x in exprs.items())},
         anchor, page_url, page_url || coalesce('#' || anchor, '') AS url,
         CASE WHEN lvl = 7 THEN 0 ELSE 100 - 10 * lvl END AS level,
         CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS page_rank
  FROM filled WHERE (lvl <> 7 OR coalesce(text, '') <> '') AND {keep}
), docs AS (
  SELECT page_id, position, type, content, anchor, page_url AS url_without_anchor, url, level, page_rank,
         {", ".join(f"lvl{k} AS hierarchy_lvl{k}" for k in range(7))},
         {", ".join(f"CASE WHEN lvl < 7 AND {deepest} = {k} THEN lvl{k} END AS hierarchy_radio_lvl{k}" for k in range(7))},
         {sql_object_id({f"lvl{k}": f"lvl{k}" for k in range(7)}, "position", "url")} AS "objectID"
  FROM shaped
)
"""
    )


EVENT_DOC = (
    ["page_id", "position", "type", "content", "anchor", "url_without_anchor", "url", "level", "page_rank"]
    + [f"hierarchy_{n}" for n in LEVELS]
    + [f"hierarchy_radio_{n}" for n in LEVELS]
    + ["objectID"]
)
EVENT_DOC_SQL = ", ".join(f'"{c}"' for c in EVENT_DOC)
DOC_CTES = event_ctes({0: "coalesce(lvl0, 'Events')"})


def event_doc_columns(docs: DataFrame) -> DataFrame:
    return docs.select(*EVENT_DOC)


# ---------------------------------------------------------------- pages to records


@query(PAGE_DOC_SQL)
def page_records(spark, folder):
    """Pages to index documents."""
    return page_doc_columns(S.page_docs(spark, folder))


@query(
    """
WITH clean AS (
  SELECT page_id, regexp_replace(html, '(?s)<script>.*?</script>', '<script></script>', 'g') AS h FROM pages
)
SELECT page_id, tag, CAST(count(*) AS BIGINT) AS nodes
FROM (SELECT page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag FROM clean)
GROUP BY page_id, tag
"""
)
def node_counts(spark, folder):
    """Elements per page and tag after decomposition."""
    nodes = node_rows(decompose(S.pages(spark, folder).select("page_id", "html")), "page_id")
    return nodes.filter("tag IS NOT NULL").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("nodes"))


@query(
    """
SELECT DISTINCT url AS src_url,
       regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || replace(link, '&amp;', '&') AS dst_url
FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)
"""
)
def page_link_table(spark, folder):
    """Distinct absolute links of every page."""
    return page_links(decompose(S.pages(spark, folder).select("page_id", "url", "html"))).distinct()


_ITEM = sql_escape(sql_strip(sql_decode("x")))
_ITEMS = "list_filter(list_transform({hits}, lambda x: " + _ITEM.replace("{", "{{").replace("}", "}}") + "), lambda t: t IS NOT NULL)"
_NAV_TEXTS = "regexp_extract_all(h, '(?s)<li><a [^>]*>(.*?)</a>', 1)"
_NAV_LINKS = "regexp_extract_all(h, '(?s)<li><a href=\"([^\"]*)\"', 1)"



@query(
    f"""
WITH clean AS (
  SELECT page_id, regexp_replace(html, '(?s)<script>.*?</script>', '', 'g') AS h FROM pages
), found AS (
  SELECT page_id, regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1) AS x,
         list_filter(list_transform(regexp_extract_all(h, '(?s)<li><a [^>]*>(.*?)</a>', 1), lambda x: {_ITEM}),
                     lambda t: t IS NOT NULL) AS items
  FROM clean
)
SELECT page_id, {_ITEM} AS title, nullif(array_to_string(items, ' '), '') AS nav,
       CAST(len(items) AS INTEGER) AS nav_items FROM found
"""
)
def page_texts(spark, folder):
    """Page-wide texts of a plain and of a path selector."""
    parsed = decompose(S.pages(spark, folder).select("page_id", "html"), css=["nav > ul li a"])
    chars = ".,;:§¶"
    items = select_nids(Selector("nav > ul li a"))
    texts = F.filter(
        F.transform(items, lambda i: texts_of(F.array(i), chars)), lambda t: t.isNotNull()
    )
    return parsed.select(
        "page_id",
        texts_of(select_nids(Selector("h1")), chars).alias("title"),
        texts_of(items, chars).alias("nav"),
        F.size(texts).alias("nav_items"),
    )


@query(
    PAGE_CTES.rsplit(", docs AS", 1)[0]
    + "SELECT page_id, CAST(count(*) AS BIGINT) AS records, CAST(sum(length(content)) AS BIGINT) AS chars FROM recs GROUP BY page_id"
)
def excluded_regions(spark, folder):
    """Menus, adverts and footers are cut out before broad selectors run."""
    spec = Spec.of(
        index_uid="pages",
        start_urls=S.PAGE_RULES,
        selectors={"lvl0": "h1", "content": "p, li, .ad, footer"},
        selectors_exclude=["nav", "div.ad", "body > footer"],
    )
    records = build_records(S.pages(spark, folder), spec)
    return records.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length("content")).cast("long").alias("chars")
    )


_FOOT = sql_escape(sql_strip(sql_decode("regexp_extract(h, '(?s)<footer>(.*?)</footer>', 1)")))


@query(
    f"""
WITH clean AS (
  SELECT page_id, regexp_replace(html, '(?s)<script>.*?</script>', '', 'g') AS h FROM pages
)
SELECT page_id, CAST(1 AS INTEGER) AS position, {sql_escape(sql_strip(sql_decode("regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1)")))} AS lvl0,
       {_FOOT} AS content FROM clean WHERE {_FOOT} IS NOT NULL
"""
)
def footer_text(spark, folder):
    """Text nodes selected by XPath, placed among the headings."""
    footer = {"selector": "//footer/text()[normalize-space()]", "type": "xpath"}
    spec = Spec.of(index_uid="pages", start_urls=S.PAGE_RULES, selectors={"lvl0": "h1", "content": footer})
    records = build_records(S.pages(spark, folder), spec).filter("type = 'content'")
    return records.select("page_id", "weight.position", F.col("hierarchy.lvl0").alias("lvl0"), "content")


@query(
    """
WITH clean AS (
  SELECT page_id, regexp_replace(html, '(?s)<script>.*?</script>', '', 'g') AS h FROM pages
)
SELECT page_id, CAST(len(regexp_extract_all(h, '<p>')) AS BIGINT) AS paragraphs,
       regexp_matches(h, '</footer>') AS has_footer,
       """
    + sql_decode("regexp_extract(h, '(?s)<title>(.*?)</title>', 1)")
    + """ AS title FROM clean
"""
)
def page_values(spark, folder):
    """XPath that gives a number, a flag or a string, as page attributes."""
    spec = Spec.of(
        index_uid="pages",
        start_urls=S.PAGE_RULES,
        selectors={
            "lvl0": "h1",
            "paragraphs": {"selector": "count(//p)", "type": "xpath"},
            "has_footer": {"selector": "boolean(//footer)", "type": "xpath"},
            "title": {"selector": "string(//title)", "type": "xpath"},
        },
    )
    values = page_attributes(parse_pages(S.pages(spark, folder), spec), spec)
    extra = F.col("extras")
    return values.select(
        "page_id",
        extra["paragraphs"].cast("double").cast("long").alias("paragraphs"),
        extra["has_footer"].cast("boolean").alias("has_footer"),
        F.get_json_object(extra["title"], "$").alias("title"),
    )


@query(
    PAGE_CTES.rsplit(", docs AS", 1)[0].rsplit(", recs AS", 1)[0]
    + f"""
SELECT c.page_id, CAST(0 AS INTEGER) AS position, lvl0 AS title,
       nullif(array_to_string({_ITEMS.format(hits=_NAV_TEXTS)}, ' '), '') AS menu
FROM cleaned c JOIN clean USING (page_id) WHERE type = 'lvl0'
"""
)
def level_attributes(spark, folder):
    """A level whose value is a map of texts found inside and around its node."""
    spec = Spec.of(
        index_uid="pages",
        start_urls=S.PAGE_RULES,
        selectors={
            "lvl0": {
                "selector": "article",
                "attributes": {"title": "h1", "menu": {"selector": "//nav//a", "type": "xpath"}},
            }
        },
    )
    records = build_records(S.pages(spark, folder), spec)
    attrs = F.col("level_attrs")["lvl0"]
    return records.select("page_id", "weight.position", attrs["title"].alias("title"), attrs["menu"].alias("menu"))


_CLEAN = "WITH clean AS (SELECT page_id, url, regexp_replace(html, '(?s)<script>.*?</script>', '', 'g') AS h FROM pages)"


@query(
    f"""
{_CLEAN}
SELECT page_id, nullif(array_to_string({_ITEMS.format(hits=_NAV_LINKS)}, ' '), '') AS links,
       nullif(array_to_string({_ITEMS.format(hits=_NAV_TEXTS)}, ' '), '') AS menu FROM clean
"""
)
def attribute_values(spark, folder):
    """Page-wide texts of attributes, alone and in a union with other paths."""
    parsed = decompose(S.pages(spark, folder).select("page_id", "html"), xml=True)
    links = page_text(Selector("//nav//a/@href", type="xpath"), ".,;:§¶")
    menu = page_text(Selector("//nav//a | //nav/@none", type="xpath"), ".,;:§¶")
    return parsed.select("page_id", links.alias("links"), menu.alias("menu"))


@query(
    PAGE_CTES.rsplit(", docs AS", 1)[0]
    + f"""
, titles AS (SELECT page_id, regexp_extract(h, '(?s)<title>(.*?)</title>', 1) AS x FROM clean)
SELECT page_id, {_ITEM} AS lvl0, count(*) AS records FROM recs JOIN titles USING (page_id) WHERE type = 'content' GROUP BY page_id, x
"""
)
def scalar_level(spark, folder):
    """A page-wide level whose XPath gives a text instead of nodes."""
    title = {"selector": "string(//title)", "type": "xpath", "global": True}
    spec = Spec.of(index_uid="pages", start_urls=S.PAGE_RULES, selectors={"lvl0": title, "content": "p"})
    records = build_records(S.pages(spark, folder), spec)
    return records.groupBy("page_id", F.col("hierarchy.lvl0").alias("lvl0")).agg(F.count(F.lit(1)).alias("records"))


@query(
    PAGE_CTES.rsplit(", matched AS", 1)[0]
    + f"""
SELECT page_id, CAST(len(paras) + 1 AS INTEGER) // 2 AS odd, CAST(greatest(len(paras) - 2, 0) AS INTEGER) AS inner_ones,
       CAST(least(len(regexp_extract_all(h, '<li>')), 1) AS INTEGER) AS last_items
FROM parts JOIN clean USING (page_id)
"""
)
def structural_selectors(spark, folder):
    """Numbers of nodes that selectors with structural conditions find."""
    css = {"odd": "article p:nth-of-type(2n+1)", "inner_ones": "article p:not(:first-of-type, :last-of-type)", "last_items": "li:last-child"}
    parsed = decompose(S.pages(spark, folder).select("page_id", "html"), css=list(css.values()))
    return parsed.select("page_id", *[F.size(select_nids(Selector(c))).alias(n) for n, c in css.items()])


@query(PAGE_DOC_SQL)
def long_selector(spark, folder):
    """A selector of thirty alternatives, of which one finds the paragraphs."""
    content = ", ".join([f".none{i} > p + p" for i in range(29)] + ["article p"])
    spec = Spec.of(index_uid="pages", start_urls=S.PAGE_RULES, selectors={"lvl0": "article > h1", "content": content})
    return page_doc_columns(S.page_docs(spark, folder, spec))


@query(
    f"""
{_CLEAN}
SELECT page_id, nullif(array_to_string({_ITEMS.format(hits=_NAV_TEXTS + "[:-2]")}, ' '), '') AS menu FROM clean
"""
)
def excluded_last(spark, folder):
    """Exclusion by what follows: the last item of each menu."""
    parsed = decompose(S.pages(spark, folder).select("page_id", "html"), exclude=["li:last-child"], css=["nav li > a"])
    return parsed.select("page_id", page_text(Selector("nav li > a"), ".,;:§¶").alias("menu"))


@query(
    "SELECT doc_id, lang FROM documents WHERE NOT (contains(text, 'license') OR contains(text, 'Copyright') OR contains(text, '404'))"
)
def stop_content(spark, folder):
    """Texts that hold none of the stop phrases."""
    docs = S.table(spark, folder, "documents").select("doc_id", "lang", "text")
    return drop_stop_content(docs, ["license", "Copyright", "404"], "text").select("doc_id", "lang")


@query(f"SELECT doc_id, {sql_escape(sql_strip('text'))} AS clean FROM documents")
def cleaned_texts(spark, folder):
    """Whole texts stripped and escaped."""
    docs = S.table(spark, folder, "documents")
    return docs.select("doc_id", T.clean_text(F.col("text"), ".,;:§¶").alias("clean"))


@query(
    r"""
SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN text ELSE regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') END AS text
FROM documents
"""
)
def declared_bodies(spark, folder):
    """Bytes back to text by the encoding that comes with them, if any."""
    docs, kind = S.table(spark, folder, "documents").select("doc_id", "text"), F.col("doc_id") % 3
    latin = F.encode(F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?"), "ISO-8859-1")
    body = F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.encode("text", "UTF-16LE")).otherwise(latin)
    encoding = F.when(kind == 0, F.lit("no-such-encoding")).when(kind == 1, F.lit("utf-16-le"))
    bodies = docs.select("doc_id", body.alias("body"), encoding.alias("encoding"))
    return decode_pages(bodies, html="text")


@query(
    r"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') END AS text
FROM documents
"""
)
def decoded_bodies(spark, folder):
    """Bytes back to text, UTF-8 first and byte by byte where that is not valid."""
    docs = S.table(spark, folder, "documents").select("doc_id", "text")
    body = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(
        F.encode(F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?"), "ISO-8859-1")
    )
    return docs.select("doc_id", decode_body(body).alias("text"))


@query(
    """
SELECT event_id, props AS extra, '"' || CAST(value AS VARCHAR) || '"' AS version,
       '"' || event_type || '"' AS kind, NULL AS nothing, '"0"' AS zero
FROM events
"""
)
def meta_attributes(spark, folder):
    """Meta tags as page attributes."""
    events = S.table(spark, folder, "events")

    def meta(name: str, content) -> F.Column:
        return F.concat(F.lit(f"<meta name='docs:{name}' content='"), content, F.lit("'>"))

    html = F.concat(
        F.lit("<html><head>"),
        meta("extra", F.lit("overwritten")),
        meta("extra", F.col("props")),
        meta("version", F.col("value").cast("string")),
        meta("kind", F.col("event_type")),
        meta("nothing", F.lit("")),
        meta("zero", F.lit("0")),
        F.lit("<meta name='other' content='x'></head><body><h1>x</h1></body></html>"),
    )
    parsed = decompose(spread(events).select("event_id", html.alias("html")))
    attrs = P.meta_attributes(F.col("nodes"), "docs:")
    return parsed.select("event_id", attrs.alias("m")).select(
        "event_id", *[F.col("m")[k].alias(k) for k in ("extra", "version", "kind", "nothing", "zero")]
    )


@query(
    """
SELECT event_id AS page_id, CASE CAST(event_id % 6 AS INTEGER)
  WHEN 0 THEN 'n' || event_id WHEN 1 THEN 'i' || event_id WHEN 2 THEN 'c' || event_id
  WHEN 3 THEN 'b' || event_id WHEN 4 THEN 'u' || event_id END AS anchor
FROM events
"""
)
def anchors(spark, folder):
    """Heading anchors: own name or id, last one inside, nearest one before, nearest one around, none."""
    event = F.col("event_id").cast("string")

    def html(before: str, after: str):
        return F.concat(F.lit(before), event, F.lit(after))

    body = (
        F.when(F.col("event_id") % 6 == 0, html('<h1 name="n', '" id="other">x</h1>'))
        .when(F.col("event_id") % 6 == 1, html('<a id="far"></a><h1 id="i', '"><a id="inner">x</a></h1>'))
        .when(F.col("event_id") % 6 == 2, html('<h1><a name="first"></a><b><a id="c', '">x</a></b></h1>'))
        .when(F.col("event_id") % 6 == 3, html('<p id="x"></p><a id="b', '"></a><div><div><h1>x</h1></div></div>'))
        .when(F.col("event_id") % 6 == 4, html('<div id="u', '"><div><a id="deep"></a></div><h1>x</h1><p id="late"></p></div>'))
        .otherwise(html("<div><h1>x ", "</h1></div><p id='late'></p>"))
    )
    events = spread(S.table(spark, folder, "events"))
    sources = events.select(F.col("event_id").alias("page_id"), F.lit("https://a.example.com/").alias("url"), body.alias("html"))
    spec = Spec.of(index_uid="anchors", start_urls=["https://a.example.com/"], selectors={"lvl0": "h1"})
    return build_records(sources, spec).select("page_id", "anchor")


# ---------------------------------------------------------------- hierarchy on ordered rows


@query(
    """
WITH turns AS (
  SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 7 END AS lvl,
         """
    + sql_escape(sql_strip("text"))
    + """ AS text FROM conversations
), states AS (
  SELECT conv_id, turn, lvl, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position,
         last_value(CASE WHEN lvl <= 0 THEN {'lvl': lvl, 'text': text} END IGNORE NULLS) OVER w AS s0,
         last_value(CASE WHEN lvl <= 1 THEN {'lvl': lvl, 'text': text} END IGNORE NULLS) OVER w AS s1
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, turn, position, CASE WHEN lvl = 7 THEN 'content' ELSE 'lvl' || lvl END AS type,
       CASE WHEN s0.lvl = 0 THEN s0.text END AS lvl0, CASE WHEN s1.lvl = 1 THEN s1.text END AS lvl1,
       CASE WHEN lvl = 7 THEN text END AS content,
       CASE WHEN lvl = 7 THEN 0 ELSE 100 - 10 * lvl END AS level
FROM states WHERE lvl <> 7 OR text IS NOT NULL
"""
)
def filldown_conversations(spark, folder):
    """Turns of a conversation as headings and content."""
    role = F.col("role")
    rows = S.table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.when(role == "system", F.lit(0)).when(role == "user", F.lit(1)).otherwise(F.lit(CONTENT)).alias("lvl"),
        T.clean_text(F.col("text"), ".,;:§¶").alias("text"),
        F.lit(None).cast("string").alias("anchor"),
    )
    rows = H.drop_empty_content(H.fill_down(rows, ["conv_id"], "turn", large=True, position="position"))
    return rows.select(
        "conv_id", "turn", "position", H.level_type(F.col("lvl")).alias("type"), "lvl0", "lvl1",
        F.when(F.col("lvl") == CONTENT, F.col("text")).alias("content"),
        T.level_weight(H.level_type(F.col("lvl"))).alias("level"),
    )


@query(EVENT_CTES + f"SELECT page_id, nid, position, {', '.join(LEVELS)}, anchor FROM filled")
def filldown_events(spark, folder):
    """Seven levels and anchors carried down, with positions."""
    return S.filled_events(spark, folder).select("page_id", "nid", "position", *LEVELS, "anchor")


def _event_docs(selectors=None, page_globals=None, **config):
    def run(spark, folder):
        records = S.event_records(spark, folder, S.event_spec(selectors, **config), page_globals)
        return event_doc_columns(I.index_docs(records))

    return run


def _add(name: str, fn, sql: str) -> None:
    QUERIES[name], SQL[name] = fn, sql


_add("event_index_docs", _event_docs({"lvl0": {"selector": "h1", "default_value": "Events"}}),
     DOC_CTES + f"SELECT {EVENT_DOC_SQL} FROM docs")
_add("records_min_level", _event_docs(min_indexed_level=3), event_ctes(keep="lvl >= 3") + f"SELECT {EVENT_DOC_SQL} FROM docs")
_add("records_content_only", _event_docs(only_content_level=True), event_ctes(keep="lvl = 7") + f"SELECT {EVENT_DOC_SQL} FROM docs")
_add(
    "records_defaults",
    _event_docs({"lvl1": {"selector": "h2", "default_value": "General"}, "content": {"selector": "p", "default_value": "none"}}),
    event_ctes({1: "coalesce(lvl1, 'General')"}, content_default="'none'") + f"SELECT {EVENT_DOC_SQL} FROM docs",
)



def _user_globals():
    user = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("user "), F.col("page_id").cast("string")))
    empty = F.lit(None).cast("string")
    return F.array(*[user if k == 2 else empty for k in range(len(LEVELS))])


@query(
    event_ctes(
        {2: "coalesce(CASE WHEN lvl >= 2 THEN CASE WHEN page_id % 3 <> 0 THEN 'user ' || page_id END ELSE lvl2 END, 'anyone')"}
    )
    + f"SELECT {EVENT_DOC_SQL} FROM docs"
)
def records_globals(spark, folder):
    """A page-wide level replaces what was carried down, from its own level on; defaults fill the rest."""
    level = {"lvl2": {"selector": "h3", "global": True, "default_value": "anyone"}}
    return _event_docs(level, _user_globals())(spark, folder)


# ---------------------------------------------------------------- index


@query(DOC_CTES + f"SELECT {EVENT_DOC_SQL}, CAST((row_number() OVER (PARTITION BY page_id ORDER BY position) - 1) // 50 + 1 AS INTEGER) AS batch FROM docs")
def emission_batches(spark, folder):
    """Number of the batch of 50 that a document is sent in."""
    path = scratch(spark, "index")
    I.rebuild(event_doc_columns(S.event_docs(spark, folder)), path)
    return I.add_batches(I.read_index(spark, path), ["page_id"], "position", large=True)


@query(DOC_CTES + "SELECT url_without_anchor, CAST(count(*) AS BIGINT) AS records FROM docs GROUP BY url_without_anchor")
def run_summary(spark, folder):
    """Records per page."""
    return I.summary(S.event_docs(spark, folder))


@query(DOC_CTES + "SELECT CAST(count(*) AS BIGINT) AS hits FROM docs")
def total_hits(spark, folder):
    return I.total_hits(I.summary(S.event_docs(spark, folder)))


_NEW = "SELECT \"objectID\", url, content || ' (new)' AS content, position FROM docs WHERE type = 'content'"
_OLD = 'SELECT "objectID", url, content, position FROM docs'


def _old_and_new(spark, folder):
    docs = S.event_docs(spark, folder)
    old = docs.select("objectID", "url", "content", "position")
    new = docs.filter("type = 'content'").select("objectID", "url", F.concat("content", F.lit(" (new)")).alias("content"), "position")
    return old, new


@query(
    DOC_CTES
    + f', new AS ({_NEW}) SELECT * FROM new UNION ALL SELECT * FROM ({_OLD}) o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n."objectID" = o."objectID")'
)
def upserted_index(spark, folder):
    """New documents replace old ones with the same id; a new one that comes twice is stored once."""
    path = scratch(spark, "upsert")
    S.event_docs(spark, folder).select("objectID", "url", "content", "position", "type").write.parquet(path)
    docs = spark.read.parquet(path)
    new = docs.filter("type = 'content'").drop("type").withColumn("content", F.concat("content", F.lit(" (new)")))
    return I.upsert(docs.drop("type"), new.unionAll(new))


@query(
    DOC_CTES
    + f""", new AS ({_NEW} AND url LIKE 'https://events.example.com/fr/%')
SELECT * FROM new UNION ALL
SELECT * FROM ({_OLD}) o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n."objectID" = o."objectID")
  AND NOT (url LIKE 'https://events.example.com/fr/1%' OR url LIKE 'https://events.example.com/fr/3%')
"""
)
def partial_update(spark, folder):
    """What is stored below some URLs is replaced by the new documents."""
    old, new = _old_and_new(spark, folder)
    new = new.filter(F.startswith("url", F.lit("https://events.example.com/fr/")))
    return I.partial_update(old, new, ["https://events.example.com/fr/1", "https://events.example.com/fr/3"])


@query(
    DOC_CTES
    + f""", new AS ({_NEW} AND url LIKE 'https://events.example.com/fr/%')
SELECT * FROM new UNION ALL
SELECT * FROM ({_OLD}) o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n."objectID" = o."objectID")
  AND NOT (url LIKE 'https://events.example.com/fr/1%' OR url LIKE 'https://events.example.com/fr/3%')
"""
)
def laid_out_update(spark, folder):
    """The partial update on an index stored by URL: only the files that meet a prefix or a new id are written again."""
    old, new = _old_and_new(spark, folder)
    root = scratch(spark, "by-url")
    UL.write(old, root)
    new = new.filter(F.startswith("url", F.lit("https://events.example.com/fr/")))
    UL.partial_update(spark, root, new, ["https://events.example.com/fr/1", "https://events.example.com/fr/3"])
    return UL.read(spark, root)


@query(
    DOC_CTES
    + """SELECT "objectID", content, hierarchy_lvl0 FROM docs
UNION ALL SELECT 'extra-' || event_type AS "objectID", event_type AS content, NULL FROM (SELECT DISTINCT event_type FROM events)"""
)
def extra_records(spark, folder):
    """Given records are appended after the crawl."""
    kinds = S.table(spark, folder, "events").select(F.col("event_type").alias("content")).distinct()
    extra = kinds.select(F.concat(F.lit("extra-"), "content").alias("objectID"), "content")
    return I.add_extra(S.event_docs(spark, folder).select("objectID", "content", "hierarchy_lvl0"), extra)


@query(DOC_CTES + f"SELECT {EVENT_DOC_SQL} FROM docs")
def rebuilt_index(spark, folder):
    """The index written anew and read back."""
    path = scratch(spark, "index")
    I.rebuild(event_doc_columns(S.event_docs(spark, folder)), path)
    return I.read_index(spark, path)


_RANK = 'page_rank DESC, level DESC, position ASC, "objectID" ASC'


@query(DOC_CTES + f'SELECT "objectID", url, page_rank, level, position FROM docs ORDER BY {_RANK} LIMIT 100')
def top_ranked(spark, folder):
    """Best documents by page rank, level and position."""
    return L.top_hits(S.event_docs(spark, folder), 100).select("objectID", "url", "page_rank", "level", "position")


@query(
    DOC_CTES
    + f'SELECT "objectID", url, page_rank, level, position FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_RANK}) AS r FROM docs) WHERE r = 1'
)
def distinct_urls(spark, folder):
    """Best document of every URL."""
    return L.distinct_by_url(S.event_docs(spark, folder)).select("objectID", "url", "page_rank", "level", "position")


@query(DOC_CTES + "SELECT \"objectID\" FROM docs WHERE starts_with(url, 'https://events.example.com/en/1')")
def ids_below_url(spark, folder):
    return L.ids_with_prefix(S.event_docs(spark, folder), "https://events.example.com/en/1")


@query(DOC_CTES + "SELECT \"objectID\" FROM docs WHERE starts_with(url, 'https://events.example.com/en/1')")
def laid_out_prefix(spark, folder):
    """Ids below a URL, read from the files of an index stored by URL whose range meets the prefix."""
    old, _ = _old_and_new(spark, folder)
    root = scratch(spark, "by-url")
    UL.write(old, root)
    return UL.read_prefix(spark, root, "https://events.example.com/en/1").select("objectID")


@query(DOC_CTES + "SELECT " + ", ".join(f'"{c}"' if c != "lang" else "CAST(NULL AS VARCHAR) AS lang" for c in L.SEARCHABLE) + " FROM docs")
def searchable_columns(spark, folder):
    return L.searchable(S.event_docs(spark, folder))


@query(DOC_CTES + "SELECT " + ", ".join(f'"{c}"' if c != "lang" else "CAST(NULL AS VARCHAR) AS lang" for c in L.DISPLAYED) + " FROM docs")
def displayed_columns(spark, folder):
    return L.displayed(S.event_docs(spark, folder))


_ALL_TEXT = "lower(concat_ws(' ', " + ", ".join([f"hierarchy_lvl{k}" for k in range(7)] + ["content"]) + "))"


@query(
    DOC_CTES
    + f"SELECT \"objectID\", url, content FROM docs WHERE list_contains(string_split({_ALL_TEXT}, ' '), 'click') AND list_contains(string_split({_ALL_TEXT}, ' '), '42')"
)
def keyword_docs(spark, folder):
    """Documents with all words of a query."""
    return L.with_words(S.event_docs(spark, folder), "Click, (42)!").select("objectID", "url", "content")


@query(
    DOC_CTES
    + f"SELECT \"objectID\", url, content FROM docs WHERE list_contains(string_split({_ALL_TEXT}, ' '), 'click') AND list_contains(string_split({_ALL_TEXT}, ' '), '42')"
)
def posted_keyword_docs(spark, folder):
    """Documents with all words of a query, found in a posting table built from all documents."""
    docs = S.event_docs(spark, folder)
    index = PO.build(docs)
    return PO.with_all_words(docs, index, "Click, (42)!").select("objectID", "url", "content")


@query(
    PAGE_CTES
    + f""", hits AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_RANK}) AS r FROM docs
  WHERE list_contains(regexp_split_to_array(lower(concat_ws(' ', hierarchy_lvl0, content)), '[^\\p{{L}}\\p{{N}}]+'), 'the')
)
SELECT "objectID", url, content, hierarchy_lvl0 FROM hits WHERE r = 1 ORDER BY {_RANK} LIMIT 50
"""
)
def page_search(spark, folder):
    """Search over the page index: matching documents, one per URL, best first."""
    return L.search(S.page_docs(spark, folder), "the", 50).select("objectID", "url", "content", "hierarchy_lvl0")


# ---------------------------------------------------------------- URLs


def urls(spark, folder) -> DataFrame:
    return S.table(spark, folder, "pages").select("page_id", "url")


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_BARE = "regexp_replace(url, '#.*$', '')"
# the tables hold no escapes, and one query form with arguments that are sorted already
_CANON = _BARE


@query(
    f"""
SELECT page_id, {_CANON} AS canonical, regexp_extract(url, '^([^?#;]*)', 1) AS plain, {_HOST} AS domain,
       '^https?' || regexp_extract(url, '^https?(.*)', 1) || '(.*)$' AS any_scheme,
       CASE WHEN starts_with(url, 'https') THEN 'http' || substr(url, 6) ELSE 'https' || substr(url, 5) END AS other_scheme,
       sha1('GET' || regexp_replace({_CANON}, '(https?)(.*)', '\\2')) AS fp, sha1('GET' || {_CANON}) AS fp_scheme,
       sha1('GET' || regexp_replace(url, '(https?)(.*)', '\\2')) AS fp_anchor
FROM pages
"""
)
def url_forms(spark, folder):
    """Canonical form, domain, scheme variants and fingerprints of the page URLs."""
    url = F.col("url")
    return urls(spark, folder).select(
        "page_id",
        U.canonical(url).alias("canonical"),
        U.drop_params(url).alias("plain"),
        U.netloc(url).alias("domain"),
        U.any_scheme(url).alias("any_scheme"),
        U.other_scheme(url).alias("other_scheme"),
        U.fingerprint(url).alias("fp"),
        U.fingerprint(url, with_scheme=True).alias("fp_scheme"),
        U.fingerprint(url, use_anchors=True).alias("fp_anchor"),
    )


@query(
    """
SELECT page_id, 'http://h.example.com/p?a=' || (page_id % 7) || '&b=1&b=2&z=' || (page_id % 10) AS canonical FROM pages
"""
)
def sorted_arguments(spark, folder):
    """Query arguments in any order give one canonical URL."""
    n = F.col("page_id")
    url = F.concat(
        F.lit("http://H.Example.com/p?z="), (n % 10).cast("string"), F.lit("&b=2&a="), (n % 7).cast("string"), F.lit("&b=1#x")
    )
    return urls(spark, folder).select("page_id", U.canonical(url).alias("canonical"))


@query(
    """
SELECT page_id, url FROM pages
WHERE (regexp_matches(url, '^https?://[^/]+/(en|fr)/(.*)$') OR regexp_matches(url, 'spam-farm'))
  AND NOT (regexp_matches(url, '\\.html') OR regexp_matches(url, '^https?://www.*(.*)$'))
"""
)
def allowed_urls(spark, folder):
    """URLs that some rule allows and no stop rule denies."""
    allow = [U.any_scheme_pattern("http://[^/]+/(en|fr)/"), "spam-farm"]
    deny = [r"\.html", U.any_scheme_pattern("https://www.*")]
    return urls(spark, folder).filter(U.follow_allowed(F.col("url"), allow, deny))


@query(
    f"SELECT page_id, url FROM pages WHERE {_HOST} = 'spam-farm.example.org' OR {_HOST} LIKE '%.example.com' OR {_HOST} = 'example.com'"
)
def domain_urls(spark, folder):
    """URLs on the allowed domains and below them."""
    return urls(spark, folder).filter(U.in_domains(F.col("url"), ["example.com", "spam-farm.example.org"]))


_ORIG = "replace(replace(url, '/fr/', '/en/'), '/es/', '/en/')"


@query(
    f"""
WITH r AS (SELECT page_id, url, {_ORIG} AS asked FROM pages), t AS (
  SELECT page_id, regexp_matches(url, '/en/|/de/') AND NOT regexp_matches(url, '\\.html') AS here,
         regexp_matches(asked, '/en/|/de/') AND NOT regexp_matches(asked, '\\.html') AS there FROM r)
SELECT page_id, here AND there AS strict_ok, here OR there AS loose_ok FROM t
"""
)
def redirects(spark, folder):
    """Redirects checked at both ends or at either end."""
    asked = F.regexp_replace("url", "/(fr|es)/", "/en/")
    allow, deny = ["/en/", "/de/"], [r"\.html"]
    return urls(spark, folder).select(
        "page_id",
        U.redirect_ok(F.col("url"), asked, allow, deny).alias("strict_ok"),
        U.redirect_ok(F.col("url"), asked, allow, deny, strict=False).alias("loose_ok"),
    )


@query(
    """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '#x' END AS url FROM pages
"""
)
def bare_fragments(spark, folder):
    """A response that only adds ``#`` is the requested page."""
    asked = F.col("url")
    got = F.when(F.col("page_id") % 2 == 0, F.concat(asked, F.lit("#"))).otherwise(F.concat(asked, F.lit("#x")))
    return urls(spark, folder).select("page_id", U.drop_bare_fragment(got, asked).alias("url"))


def _requests(spark, folder) -> DataFrame:
    """Every page asked for three times: as it is, under the other scheme, and as a redirect."""
    base = urls(spark, folder)
    plain = base.select((F.col("page_id") * 3).alias("ord"), "url", F.lit(False).alias("redirected"))
    other = base.select((F.col("page_id") * 3 + 1).alias("ord"), U.other_scheme(F.col("url")).alias("url"), F.lit(False).alias("redirected"))
    moved = base.select(
        (F.col("page_id") * 3 + 2).alias("ord"),
        F.when(F.col("page_id") % 2 == 0, U.other_scheme(F.col("url"))).otherwise(F.col("url")).alias("url"),
        F.lit(True).alias("redirected"),
    )
    return plain.unionByName(other).unionByName(moved)


_OTHER = "CASE WHEN starts_with(url, 'https') THEN 'http' || substr(url, 6) ELSE 'https' || substr(url, 5) END"
_REQUESTS = f"""
WITH reqs AS (
  SELECT page_id * 3 AS ord, url, false AS redirected FROM pages
  UNION ALL SELECT page_id * 3 + 1, {_OTHER}, false FROM pages
  UNION ALL SELECT page_id * 3 + 2, CASE WHEN page_id % 2 = 0 THEN {_OTHER} ELSE url END, true FROM pages
), keyed AS (
  SELECT *, regexp_replace({_CANON}, '^https?', '') AS k, {_CANON} AS ks FROM reqs
)"""


@query(_REQUESTS + " SELECT ord, url FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS r FROM keyed) WHERE r = 1")
def deduped_requests(spark, folder):
    """First request of every page, whatever the scheme."""
    return C.dedupe_requests(_requests(spark, folder)).select("ord", "url")


@query(
    _REQUESTS
    + """, firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS r FROM keyed) WHERE r = 1 AND NOT redirected
), cand AS (
  SELECT ord, url, ks, redirected FROM firsts UNION ALL SELECT ord, url, ks, redirected FROM keyed WHERE redirected
)
SELECT ord, url, redirected FROM (SELECT *, row_number() OVER (PARTITION BY ks ORDER BY ord) AS r FROM cand) WHERE r = 1
"""
)
def deduped_redirects(spark, folder):
    """The same, with redirects compared under their scheme."""
    return C.dedupe_requests(_requests(spark, folder), flagged="redirected").select("ord", "url", "redirected")


@query(
    f"""
SELECT page_id, url FROM pages WHERE {_HOST} NOT IN (
  SELECT {_HOST} FROM pages WHERE regexp_matches(url, '/(fr|de)/') )
"""
)
def unseen_hosts(spark, folder):
    """Requests whose fingerprint was not seen before; here on host level."""
    base = urls(spark, folder)
    host = F.concat(F.lit("http://"), U.netloc(F.col("url")))
    seen = base.filter(U.found(F.col("url"), "/(fr|de)/")).select(U.fingerprint(host).alias("fp"))
    return C.not_seen(base.withColumn("host", host), seen, "host").select("page_id", "url")


@query(
    f"""
WITH host AS (SELECT DISTINCT {_HOST} AS h FROM pages),
wanted AS (SELECT 'http://' || h || '/' AS url, h FROM host),
ok AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' AS fetched FROM pages)
SELECT w.url, coalesce(a.fetched, b.fetched) AS fetched_url,
       CASE WHEN a.fetched IS NOT NULL THEN false WHEN b.fetched IS NOT NULL THEN true END AS is_fallback
FROM wanted w LEFT JOIN ok a ON a.fetched = w.url LEFT JOIN ok b ON b.fetched = 'https' || substr(w.url, 5)
"""
)
def fallback_seeds(spark, folder):
    """Seeds with an error are tried under the other scheme."""
    root = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/"))
    fetched = urls(spark, folder).select(root.alias("url")).distinct().withColumn("status", F.lit(200))
    failed = fetched.select(U.other_scheme(F.col("url")).alias("url"), F.lit(404).alias("status"))
    wanted = fetched.select(F.concat(F.lit("http://"), U.netloc(F.col("url")), F.lit("/")).alias("url")).distinct()
    return C.with_fallback(wanted, fetched.unionByName(failed))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^https?://spam-farm.example.org/en/728')  AND regexp_matches(url, '^https?://.*(.*)$')")
def without_start_pages(spark, folder):
    """Start pages are followed but give no records."""
    starts = ["https://spam-farm.example.org/en/728?utm_source=feed", "https://spam-farm.example.org/en/728", "http://.*"]
    spec = Spec.of(index_uid="p", start_urls=starts, scrape_start_urls=False)
    pages = urls(spark, folder).withColumn("request_url", F.regexp_replace("url", r"\?.*", ""))
    return C.record_pages(pages, spec).select("page_id", "url")


_MAPPED = "SELECT h, 'http://' || h || '/sitemap.xml' AS sitemap_url, url FROM (SELECT {host} AS h, url FROM pages)".format(host=_HOST)


def _sitemaps(spark, folder) -> DataFrame:
    """One sitemap per page, as sites with one file per section have."""
    host = U.netloc(F.col("url"))
    loc = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    alternate = F.concat(F.lit("http://alt.example.com/"), F.col("page_id").cast("string"))
    xml = F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" '),
        F.lit('xmlns:xhtml="http://www.w3.org/1999/xhtml"><url><loc>\n'),
        loc,
        F.lit('</loc><xhtml:link rel="alternate" hreflang="de" href="'),
        alternate,
        F.lit('"/></url></urlset>'),
    )
    return urls(spark, folder).select(F.concat(F.lit("http://"), host, F.lit("/sitemap.xml")).alias("url"), xml.alias("xml"))


@query(
    f"""
SELECT 'http://' || {_HOST} || '/sitemap.xml' AS sitemap_url, 0 AS ord, url FROM pages
UNION ALL SELECT 'http://' || {_HOST} || '/sitemap.xml', 1, 'http://alt.example.com/' || page_id FROM pages
"""
)
def sitemap_scan(spark, folder):
    """Page URLs of sitemaps with alternate links."""
    return sitemap_urls(_sitemaps(spark, folder), alternate_links=True)


@query("SELECT DISTINCT url FROM pages WHERE page_id % 10 <> 9")
def deep_sitemaps(spark, folder):
    """Page URLs below four levels of sitemap indexes that also point back to their root; some sitemaps are in no index."""
    page, host = F.col("page_id"), F.lit("http://maps.example.com/")

    def name(level: int, number) -> Column:
        return F.concat(host, F.lit(f"{level}/"), number.cast("string"))

    def index(level: int, number, below) -> DataFrame:
        rows = ids.filter(page % 10 != 9).select(name(level, number).alias("url"), name(level + 1, below).alias("b")).distinct()
        links = F.concat_ws("", F.transform(F.collect_list("b"), lambda b: F.concat(F.lit("<sitemap><loc>"), b, F.lit("</loc></sitemap>"))))
        root = F.lit("<sitemap><loc>http://maps.example.com/0/0</loc></sitemap>")
        return rows.groupBy("url").agg(F.concat(F.lit("<sitemapindex>"), links, root, F.lit("</sitemapindex>")).alias("xml"))

    ids = S.table(spark, folder, "pages").select("page_id", "url")
    leaf = F.concat(F.lit("<urlset><url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>"))
    maps = ids.select(name(4, page).alias("url"), leaf.alias("xml"))
    steps = [F.lit(0), page % 2, page % 6, page % 60, page]
    for level in range(4):
        maps = maps.unionByName(index(level, steps[level], steps[level + 1]))
    return crawl_sitemaps(maps, ["http://maps.example.com/0/0"]).select("url").distinct()


_SITEMAP_SPEC = dict(
    index_uid="p",
    start_urls=["http://.*/(en|fr)/"],
    stop_urls=[r"\.html"],
    sitemap_urls=["http://x/sitemap.xml"],
    sitemap_urls_regexs=["/en/", "/de/"],
)
_FROM_MAP = "regexp_matches(url, '/en/|/de/')"
_RULED = "regexp_matches(url, '^https?://.*/(en|fr)/(.*)$') AND NOT regexp_matches(url, '\\.html')"


@query(
    f"""
SELECT page_id, url, {_RULED} AS ruled FROM pages WHERE {_FROM_MAP}
"""
)
def sitemap_page_rules(spark, folder):
    """Sitemap pages, forced and with the page rules."""
    pages = urls(spark, folder).withColumn("request_url", F.col("url"))
    forced = C.sitemap_pages(pages, Spec.of(_SITEMAP_SPEC, force_sitemap_urls_crawling=True)).select("page_id", "url")
    ruled = C.sitemap_pages(pages, Spec.of(_SITEMAP_SPEC)).select("page_id", F.lit(True).alias("ruled"))
    return forced.join(ruled, "page_id", "left").select("page_id", "url", F.coalesce("ruled", F.lit(False)).alias("ruled"))


@query(
    f"""
WITH all_pages AS (
  SELECT page_id, url, true AS from_sitemap FROM pages WHERE {_FROM_MAP} AND {_RULED}
  UNION ALL SELECT page_id, url, false FROM pages WHERE {_RULED}
)
SELECT page_id, url, from_sitemap FROM (
  SELECT *, row_number() OVER (PARTITION BY regexp_replace({_CANON}, '^https?', '') ORDER BY from_sitemap DESC, page_id) AS r FROM all_pages
) WHERE r = 1
"""
)
def page_set(spark, folder):
    """Sitemap and crawled pages, each once, sitemap pages first."""
    spec = Spec.of(_SITEMAP_SPEC)
    pages = urls(spark, folder).withColumn("request_url", F.col("url"))
    return C.page_set(C.sitemap_pages(pages, spec), C.record_pages(pages, spec)).select("page_id", "url", "from_sitemap")


@query(
    PAGE_CTES
    + f""", hub AS (SELECT 1 FROM pages WHERE regexp_matches(url, '/fr/') AND page_id % 5 = 0 LIMIT 1), ranked AS (
  SELECT page_id, row_number() OVER (PARTITION BY regexp_replace({_CANON}, '^https?', '') ORDER BY page_id) AS r FROM pages
  WHERE regexp_matches(url, '/fr/') OR (regexp_matches(url, '/es/') AND EXISTS (SELECT 1 FROM hub))
)
SELECT page_id, url, position, type, content, "objectID" FROM docs WHERE page_id IN (SELECT page_id FROM ranked WHERE r = 1)
"""
)
def site_run(spark, folder):
    """A whole run: a start page leads to the pages of its language, some of those to the next language."""
    pages = S.pages(spark, folder)
    lang = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    hub = F.concat(F.lit("http://hub.example.com/"), lang, F.lit("/"))
    base = urls(spark, folder)
    down = base.select(hub.alias("src_url"), F.col("url").alias("dst_url"))
    across = base.filter(lang == "fr").filter(F.col("page_id") % 5 == 0)
    across = across.select(F.col("url").alias("src_url"), F.lit("http://hub.example.com/es/").alias("dst_url"))
    spec = Spec.of(
        index_uid="site",
        start_urls=["http://hub.example.com/fr/", *S.PAGE_RULES, "http://.*/(fr|es)/"],
        allowed_domains=["example.com", "example.net", "example.org"],
        stop_urls=["/en/", "/de/"],
        selectors={"lvl0": "h1", "content": "p"},
    )
    docs = I.index_docs(run_plan.run(pages, spec, links=down.unionByName(across)))
    return docs.select("page_id", "url", "position", "type", "content", "objectID")


_EDGES = "WITH RECURSIVE edges AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem), "


def _edges(spark, folder) -> DataFrame:
    """Order lines as links from an order number to a part number; numbers below the part count lead on."""
    return S.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


@query(_EDGES + "reach AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT e.dst FROM reach r JOIN edges e ON e.src = r.node) SELECT node FROM reach")
def reachable_nodes(spark, folder):
    """Everything reachable from one start node over the links."""
    edges = _edges(spark, folder)
    start = edges.select(F.col("src").alias("node")).filter("node = 1")
    return C.reachable(edges, start).select("node")


@query(_EDGES + "hop AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT dst FROM edges WHERE src = 1) SELECT node FROM hop")
def one_hop_nodes(spark, folder):
    """Links of the start pages only."""
    edges = _edges(spark, folder)
    return C.reachable(edges, edges.select(F.col("src").alias("node")).filter("node = 1"), max_hops=1).select("node")


@query(
    DOC_CTES
    + """, per AS (SELECT page_id, page_id % 3 = 0 AS from_sitemap, CAST(count(*) AS BIGINT) AS records FROM docs GROUP BY page_id),
run AS (SELECT *, coalesce(sum(records) OVER (ORDER BY from_sitemap DESC, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(records) OVER () AS total FROM per)
SELECT page_id, from_sitemap, records, CAST(before AS BIGINT) AS before FROM run WHERE before <= 5000
"""
)
def hit_cap(spark, folder):
    """Pages that stay below the cap on records."""
    docs = S.event_docs(spark, folder)
    per_page = docs.groupBy("page_id").agg(F.count(F.lit(1)).alias("records"))
    per_page = per_page.withColumn("from_sitemap", F.col("page_id") % 3 == 0)
    return C.cap_pages(per_page, 5000).select("page_id", "from_sitemap", "records", "before")


# ---------------------------------------------------------------- URL rules


def _rules(spark, folder) -> DataFrame:
    """One rule per page: its domain with two variables."""
    root = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    langs = F.array(*[F.lit(x) for x in S.LANGS])
    years = F.array(F.lit("2023"), F.lit("2024"))
    return S.table(spark, folder, "pages").select(
        F.col("page_id").alias("ord"),
        F.concat(root, F.lit("/(?P<lang>.*?)/(?P<year>.*?)/")).alias("url"),
        F.create_map(F.lit("lang"), langs, F.lit("year"), years).alias("variables"),
    )


_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query(
    f"""
SELECT page_id AS ord, {_ROOT} || '/(?P<lang>.*?)/(?P<year>.*?)/' AS url, 'lang,year' AS names,
       0 AS page_rank, 0 AS tags, 'default' AS selectors_key FROM pages
"""
)
def normalised_rules(spark, folder):
    """Rules with their defaults and variable names."""
    rules = R.normalise_rules(_rules(spark, folder))
    names = F.array_join(U.variable_names(F.col("url")), ",")
    return rules.select("ord", "url", names.alias("names"), "page_rank", F.size("tags").alias("tags"), "selectors_key")


@query(
    f"""
SELECT page_id AS ord, {_ROOT} || '/' || l.lang || '/' || y.year || '/' AS url, l.lang, y.year, l.i || ',' || y.i AS path
FROM pages, (VALUES ('en', 0), ('fr', 1), ('de', 2), ('es', 3)) l(lang, i), (VALUES ('2023', 0), ('2024', 1)) y(year, i)
"""
)
def expanded_rules(spark, folder):
    """Every combination of the URL variables written out."""
    rules = R.expand_variables(_rules(spark, folder))
    attrs = F.col("url_attributes")
    return rules.select("ord", "url", attrs["lang"].alias("lang"), attrs["year"].alias("year"), F.array_join("path", ",").alias("path"))


@query(
    f"""
SELECT page_id AS ord, {_ROOT} || '/' || a.v || '/' || b.v || '/c2/c3/c4/c5/c6/c7/c8/c9/' AS url
FROM pages, (VALUES ('a'), ('b')) a(v), (VALUES ('x'), ('y'), ('z')) b(v)
"""
)
def many_variables(spark, folder):
    """Ten URL variables in one rule."""
    names = [f"v{i}" for i in range(10)]
    values = {n: F.array(F.lit(f"c{i}")) for i, n in enumerate(names)} | {"v0": F.array(F.lit("a"), F.lit("b")), "v1": F.array(*map(F.lit, "xyz"))}
    variables = F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)])
    path = "/" + "/".join(f"(?P<{n}>.*?)" for n in names) + "/"
    root = F.regexp_replace("url", r"\(\?P<.*", "")
    rules = _rules(spark, folder).select("ord", F.concat(F.rtrim(root, F.lit("/")), F.lit(path)).alias("url"), variables.alias("variables"))
    return R.expand_variables(rules).select("ord", "url")


@query("SELECT 'lang' AS facet FROM pages UNION SELECT 'year' FROM pages")
def facets(spark, folder):
    """Names of the URL variables in use."""
    return R.facet_names(R.expand_variables(_rules(spark, folder)))


@query(f"SELECT {_HOST} AS domain, min(page_id) AS ord FROM pages GROUP BY 1")
def allowed_domains(spark, folder):
    """Domains in first-seen order."""
    return R.allowed_domains(urls(spark, folder).withColumnRenamed("page_id", "ord"))


_SETS = [
    {"url": "https?://www", "selectors_key": "www", "tags": ["w"], "page_rank": 9, "extra_attributes": {"site": "main"}},
    {"url": "/fr/", "selectors_key": "fr", "tags": ["never: not at the start"], "page_rank": 8},
    {"url": "https?://blog", "selectors_key": "blog", "tags": ["b", "c"], "page_rank": -1},
    {"url": "https?://", "selectors_key": "rest", "page_rank": 1, "extra_attributes": {"site": "other", "n": 2}},
]


@query(
    """
SELECT page_id,
  CASE WHEN regexp_matches(url, 'https?://www') THEN 'www' WHEN regexp_matches(url, '/fr/') THEN 'fr'
       WHEN regexp_matches(url, 'https?://blog') THEN 'blog' ELSE 'rest' END AS selectors_key,
  CASE WHEN regexp_matches(url, '^https?://www') THEN 9 WHEN regexp_matches(url, '^https?://blog') THEN -1 ELSE 1 END AS page_rank,
  CASE WHEN regexp_matches(url, '^https?://www') THEN 'w' WHEN regexp_matches(url, '^https?://blog') THEN 'b,c' ELSE '' END AS tags,
  CASE WHEN regexp_matches(url, '^https?://www') THEN '"main"' ELSE '"other"' END AS site,
  CASE WHEN regexp_matches(url, '^https?://www') THEN NULL ELSE '2' END AS n
FROM pages
"""
)
def page_rules(spark, folder):
    """First matching rule of every page: selector set, rank, tags, extra attributes."""
    rules = Spec.of(index_uid="p", start_urls=_SETS).start_urls
    url = F.col("url")
    extra = P.extra_attributes(url, rules)
    return urls(spark, folder).select(
        "page_id",
        P.selector_key(url, rules).alias("selectors_key"),
        P.page_rank(url, rules).alias("page_rank"),
        F.array_join(P.page_tags(url, rules), ",").alias("tags"),
        extra["site"].alias("site"),
        extra["n"].alias("n"),
    )


@query(
    f"""
WITH r AS (
  SELECT p.page_id * 4 + l.i AS ord, {_ROOT} || '/' || l.lang || '/' AS pattern
  FROM pages p, (VALUES ('en', 0), ('fr', 1), ('de', 2), ('es', 3)) l(lang, i)
)
SELECT u.page_id,
       min(r.ord) FILTER (WHERE regexp_matches(u.url, r.pattern)) AS found_ord,
       min(r.ord) FILTER (WHERE regexp_matches(u.url, '^(?:' || r.pattern || ')')) AS start_ord
FROM pages u, r
GROUP BY u.page_id
"""
)
def rule_table(spark, folder):
    """First of a table of rules per page, four for every page of the table, matched by an equi-join on literals."""
    langs = F.array(*[F.lit(x) for x in S.LANGS])
    root = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    made = urls(spark, folder).select("page_id", root.alias("root"), F.posexplode(langs).alias("i", "lang"))
    rules = made.select((F.col("page_id") * 4 + F.col("i")).alias("ord"), F.concat("root", F.lit("/"), "lang", F.lit("/")).alias("pattern"))
    return RT.first_rules(urls(spark, folder), rules).select("page_id", "found_ord", "start_ord")


@query(
    """
WITH v AS (
  SELECT page_id, url, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang FROM pages
), w AS (
  SELECT page_id, url, CASE WHEN lang IN ('en', 'fr') THEN lang END AS lang,
         CASE WHEN lang IN ('en', 'fr') THEN replace(url, lang, '') ELSE url END AS bare FROM v
)
SELECT page_id, '"' || lang || '"' AS lang, bare, bare || '#top' AS anchored, url = bare AS no_variables FROM w
"""
)
def url_variables(spark, folder):
    """Variables found in the URL, and the URL without their text."""
    rule = {"url": "https?://[^/]+/(?P<lang>.*?)/", "variables": {"lang": ["en", "fr"]}}
    rules = Spec.of(index_uid="p", start_urls=[rule]).start_urls
    found = urls(spark, folder).withColumn("v", P.url_variables(F.col("url"), rules))
    bare = F.col("v.url")
    return found.select(
        "page_id",
        F.col("v.vars")["lang"].alias("lang"),
        bare.alias("bare"),
        F.concat(bare, F.lit("#"), F.lit("top")).alias("anchored"),
        (F.col("url") == bare).alias("no_variables"),
    )


@query(
    PAGE_CTES
    + """
SELECT page_id, type, CASE WHEN regexp_matches(url, '/fr/') THEN NULL ELSE hierarchy_lvl0 END AS lvl0, position, content FROM docs
WHERE NOT regexp_matches(url, '/de/') OR type = 'content'
"""
)
def selector_sets(spark, folder):
    """Pages with different selector sets and minimum levels in one run."""
    rules = [
        {"url": "https?://[^/]+/fr/", "selectors_key": "fr"},
        {"url": "https?://[^/]+/de/", "selectors_key": "de"},
        {"url": "https?://", "selectors_key": "default"},
    ]
    plain = {"lvl0": "h1", "content": "p"}
    # the French set wants the title as content of a level that its pages do not have
    french = {"lvl0": {"selector": "h1.none"}, "lvl1": "h1", "content": "p"}
    spec = Spec.of(
        index_uid="pages",
        start_urls=rules,
        selectors={"default": plain, "fr": french, "de": plain},
        min_indexed_level={"default": 0, "de": 1},
    )
    docs = I.index_docs(build_records(S.pages(spark, folder), spec))
    kind = F.when(F.col("type") == "lvl1", F.lit("lvl0")).otherwise(F.col("type"))
    return docs.select("page_id", kind.alias("type"), F.col("hierarchy_lvl0").alias("lvl0"), "position", "content")


# ---------------------------------------------------------------- streams


@query(PAGE_DOC_SQL)
def streamed_index(spark, folder):
    """Pages read as a stream; every micro-batch goes through the batch plan into the index."""
    path, state = scratch(spark, "stream-index"), scratch(spark, "stream-state")
    source = stream.page_stream(spark, f"{folder}/pages*.parquet")
    running = stream.stream_records(source, S.PAGE_SPEC, stream.batch_writer(path), state)
    running.awaitTermination()
    return page_doc_columns(stream.current_docs(spark, path))


_FIRST_SEEN = f"""
SELECT min(page_id) AS page_id, fp FROM (SELECT page_id, sha1('GET' || regexp_replace({_CANON}, '(https?)(.*)', '\\2')) AS fp FROM pages)
GROUP BY fp
"""


@query(_FIRST_SEEN)
def streamed_first_seen(spark, folder):
    """Pages that pass the streaming deduplication: the first of each fingerprint."""
    path, seen, state = (scratch(spark, f"stream-{n}") for n in ("pages", "seen", "state"))
    source = stream.page_stream(spark, f"{folder}/pages*.parquet").select("page_id", "url")

    def each(batch, batch_id):
        stream.first_seen(batch, batch_id, seen).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    source.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("page_id", U.fingerprint(F.col("url")).alias("fp"))


@query(_FIRST_SEEN)
def streamed_first_kept(spark, folder):
    """The same deduplication with keyed state (a value per fingerprint in the state store), no read of earlier batches."""
    out, state = scratch(spark, "keyed-pages"), scratch(spark, "keyed-state")
    source = stream.page_stream(spark, f"{folder}/pages*.parquet").select("page_id", "url")
    kept = KS.first_seen_keyed(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    kept.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("page_id long, url string, _fp string").parquet(out).select("page_id", U.fingerprint(F.col("url")).alias("fp"))
