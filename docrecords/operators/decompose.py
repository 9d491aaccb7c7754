"""Pages to ordered nodes: the only stage that runs Python on executors.

Every page becomes one row with three page-local columns:

``nodes``  elements and text fragments in document order; the array index is the node id
``frags``  the text fragments; the text of a subtree is a contiguous slice of it
``xml``, ``xml_text``  well-formed forms for XPath, only built when a selector needs them
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator, Sequence
from html.entities import name2codepoint

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrecords.functions.urls import resolve_link
from docrecords.operators import css as _css
from docrecords.operators.css import Compound, css_column, matches_path, parse_css

# ship the page parser with its tasks, so that executors need no installed copy of this package
for _module in (_css, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

NODE = T.StructType(
    [
        T.StructField("nid", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("lo", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("anchor_in", T.IntegerType()),
        T.StructField("anchor_before", T.IntegerType()),
    ]
)
FRAG = T.StructType([T.StructField("s", T.StringType()), T.StructField("keep", T.StringType())])

# HTML elements without content.
VOID = frozenset("area base basefont br col embed frame hr img input isindex link meta param source track wbr".split())
# Elements that may stand in the head.
HEAD = frozenset("title meta link script style base noscript".split())
# Elements that end an open paragraph.
BLOCKS = frozenset(
    "address article aside blockquote center details dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html body table caption td th button object template".split())
# start tag -> (open elements it ends, elements it does not look beyond)
ENDS = {
    **{tag: ({"p"}, SCOPE) for tag in BLOCKS},
    **{tag: ({"p"} | HEADINGS, SCOPE) for tag in HEADINGS},
    "li": ({"p", "li"}, SCOPE | {"ul", "ol", "menu", "dir"}),
    "dt": ({"p", "dt", "dd"}, SCOPE | {"dl"}),
    "dd": ({"p", "dt", "dd"}, SCOPE | {"dl"}),
    "a": ({"a"}, SCOPE),
    "option": ({"option"}, SCOPE | {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, SCOPE | {"select"}),
    "tr": ({"tr", "caption"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    **{tag: ({"tbody", "thead", "tfoot", "tr", "caption"}, {"table"}) for tag in ("tbody", "thead", "tfoot")},
}
# an end tag does not reach across an open element of higher rank
RANK = {"div": 1, "td": 2, "th": 2, "tr": 3, "tbody": 4, "thead": 4, "tfoot": 4, "table": 5, "body": 6}

TOKEN = re.compile(
    r"<(script|style)\b([^>]*)>(.*?)(?:</\1[^>]*>|\Z)"
    r"|<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>=]+|=)*+)>"
    r"|<[!?/][^>]*>?"
    r"|([^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
REFERENCE = re.compile(r"&(?:#(\d+);?|#[xX]([0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*);)")
CODES = {**name2codepoint, "apos": 39}
# XML parsers refuse very long names: longer ones are cut and told apart by their digest
LONGEST_NAME = 200
NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


class _Open:
    """An open element."""

    __slots__ = (
        "tag", "attrs", "nid", "up", "left", "place", "type_place", "types", "kids", "scope", "lo", "skip", "run", "bare",
        "after", "type_after", "empty", "text",
    )

    def __init__(self, tag, attrs, nid, up, scope, lo, skip):
        self.tag, self.attrs, self.nid, self.up, self.scope, self.lo, self.skip = tag, attrs, nid, up, scope, lo, skip
        self.left = up.kids if up else None
        self.place = self.left.place + 1 if self.left else 1
        self.types = {}  # child elements so far, by name
        if up:
            up.types[tag] = up.types.get(tag, 0) + 1
        self.type_place = up.types[tag] if up else 1
        self.kids = None  # latest child element
        self.run = False  # the latest item inside is text
        self.bare = True  # nothing inside yet


class _Columns:
    """Node and fragment values of one output batch, column by column."""

    def __init__(self):
        self.parent, self.last, self.tag, self.attrs, self.lo, self.n = [], [], [], [], [], []
        self.anchor_in, self.anchor_before = [], []
        self.frag, self.keep = [], []


def _character(ref: re.Match) -> str:
    decimal, hexa, name = ref.groups()
    if name:
        return chr(CODES[name]) if name in CODES else ref[0]
    digits = (decimal or hexa).lstrip("0")
    code = int(digits or "0", 10 if decimal else 16) if len(digits) < 8 else 0
    return NOT_XML.sub("", chr(code)) if code <= 0x10FFFF else ""


def unescape(s: str) -> str:
    """Character references as text. A name counts only with its semicolon, a number also without."""
    return REFERENCE.sub(_character, s)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTR.findall(raw):
        value = double or single or bare
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


def settle(elements: list[_Open], cols: _Columns, base: int, frag_base: int) -> None:
    """What is known of the elements of a page once it is read, among those that are left: places, later siblings, texts."""
    for el in elements:
        el.kids, el.types = None, {}
    for el in elements:
        up = el.up
        el.left = up.kids if up else None
        el.place = el.left.place + 1 if el.left else 1
        if up:
            up.types[el.tag] = up.types.get(el.tag, 0) + 1
            up.kids = el
        el.type_place = up.types[el.tag] if up else 1
        at = base + el.nid

        def text(lo: int = frag_base + cols.lo[at], n: int = cols.n[at]) -> str:
            return "".join(cols.frag[lo : lo + n])

        el.text = text
    for el in elements:
        el.after = el.up.kids.place - el.place if el.up else 0
        el.type_after = el.up.types[el.tag] - el.type_place if el.up else 0
        el.empty = el.kids is None and cols.n[base + el.nid] == 0


def parse_page(
    html: str, out: _Columns, exclude: Sequence[list[tuple[str, Compound]]], keep: frozenset[str], dropped: frozenset[int] = frozenset(),
    opened: list[_Open] | None = None,
) -> None:
    """Append the nodes and fragments of one page. Excluded subtrees leave no trace, the text around them joins.

    ``dropped``: elements to exclude by their number in order of opening. ``opened`` gets the elements that are left.
    """
    base, frag_base = len(out.parent), len(out.frag)
    count = 0
    stack: list[_Open] = []
    seen_head = seen_body = False
    anchor_seen = -1

    def push(tag: str, attrs: dict[str, str]) -> None:
        nonlocal anchor_seen, count
        up = stack[-1] if stack else None
        skip = bool(up and up.skip)
        el = _Open(tag, attrs, len(out.parent) - base, up, up.scope if up else -1, len(out.frag), skip)
        if exclude and not skip:
            el.skip = any(matches_path(el, path) for path in exclude)
        el.skip = el.skip or count in dropped
        count += 1
        if opened is not None and not el.skip:
            opened.append(el)
        if up:
            up.kids = el
        if not el.skip:
            out.parent.append(up.nid if up else -1)
            out.last.append(el.nid)
            out.tag.append(tag)
            out.attrs.append(attrs or None)
            out.lo.append(el.lo - frag_base)
            out.n.append(0)
            out.anchor_in.append(None)
            out.anchor_before.append(el.scope if el.scope >= 0 else None)
            if up:
                up.run = up.bare = False
            if attrs and ("name" in attrs or "id" in attrs):
                anchor_seen = el.scope = el.nid
                if up:
                    up.scope = el.nid
        stack.append(el)

    def pop() -> None:
        el = stack.pop()
        if not el.skip:
            at = base + el.nid
            out.last[at] = len(out.parent) - base - 1
            out.n[at] = len(out.frag) - el.lo
            if anchor_seen >= el.nid:
                out.anchor_in[at] = anchor_seen

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            pop()

    def start(tag: str, attrs: dict[str, str], closed: bool) -> None:
        nonlocal seen_head, seen_body
        if not stack:
            push("html", attrs if tag == "html" else {})
        if tag == "html":
            return
        if tag == "head":
            if not seen_head and not seen_body:
                seen_head = True
                push(tag, attrs)
            return
        if tag in HEAD and not seen_body:
            if not seen_head:
                seen_head = True
                push("head", {})
        elif not seen_body:
            seen_body = True
            pop_to(1)
            push("body", attrs if tag == "body" else {})
        if tag == "body":
            return
        ends, barrier = ENDS.get(tag, ((), ()))
        cut = 0
        for depth in range(len(stack) - 1, 1, -1):
            name = stack[depth].tag
            if name in barrier:
                break
            if name in ends:
                cut = depth
        if cut:
            pop_to(cut)
        push(tag, attrs)
        if closed or tag in VOID:
            pop()

    def end(tag: str) -> None:
        if tag in ("html", "body"):
            # what follows still belongs to the body
            pop_to(2 if seen_body else len(stack))
            return
        rank = RANK.get(tag, 0)
        for depth in range(len(stack) - 1, 0, -1):
            name = stack[depth].tag
            if name == tag:
                pop_to(depth)
                return
            if RANK.get(name, 0) > rank:
                return

    def text(s: str) -> None:
        nonlocal seen_body
        if not seen_body and (not stack or stack[-1].tag in ("html", "head")):
            if not s.strip():
                return
            start("body", {}, False)
            push("p", {})
        box = stack[-1]
        if box.skip:
            return
        if box.run:
            out.frag[-1] += s
            return
        out.parent.append(box.nid)
        out.last.append(len(out.parent) - 1 - base)
        out.tag.append(None)
        out.attrs.append(None)
        out.lo.append(len(out.frag) - frag_base)
        out.n.append(1)
        out.anchor_in.append(None)
        out.anchor_before.append(None)
        out.frag.append(s)
        out.keep.append(box.tag if box.bare and box.tag in keep else None)
        box.run, box.bare = True, False

    for token in TOKEN.finditer(html):
        raw_tag, raw_attrs, raw_body, slash, tag, attrs, plain = token.groups()
        if plain is not None:
            text(unescape(plain) if "&" in plain else plain)
        elif tag:
            if slash:
                end(tag.lower())
            else:
                values = _attributes(attrs) if attrs and not attrs.isspace() else {}
                closed = attrs.endswith("/") and (attrs[-2:-1] in ("", " ", "\n", "\t", '"', "'") or "=" not in attrs)
                start(tag.lower(), values, closed)
        elif raw_tag:
            start(raw_tag.lower(), _attributes(raw_attrs), False)
            if raw_body:
                text(raw_body)
            end(raw_tag.lower())
        elif token[0].startswith("<!--") and stack and not stack[-1].skip:
            stack[-1].run = stack[-1].bare = False
    if not stack:
        push("html", {})
    pop_to(0)


def short_name(name: str) -> str:
    """A name as it is written in the XML forms."""
    if len(name) <= LONGEST_NAME:
        return name
    return f"{name[:LONGEST_NAME - 33]}_{hashlib.md5(name.encode()).hexdigest()}"


def _dropped(html: str, paths: Sequence[list[tuple[str, Compound]]]) -> frozenset[int]:
    """Elements that exclusions select which need the whole page, by number."""
    cols, opened = _Columns(), []
    parse_page(html, cols, (), frozenset(), opened=opened)
    settle(opened, cols, 0, 0)
    return frozenset(i for i, el in enumerate(opened) if any(matches_path(el, p) for p in paths))


def _xml(cols: _Columns, lo: int, hi: int, frag_lo: int, mark_text: bool) -> str:
    """Well-formed XML of the nodes ``lo..hi``; every element carries its node id."""
    parts: list[str] = []
    open_tags: list[tuple[int, str]] = []

    def esc(s: str) -> str:
        return NOT_XML.sub("", s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    for nid in range(hi - lo):
        while open_tags and open_tags[-1][0] < nid:
            parts.append(f"</{open_tags.pop()[1]}>")
        tag = cols.tag[lo + nid]
        if tag is None:
            s = esc(cols.frag[frag_lo + cols.lo[lo + nid]])
            parts.append(f'<_t nid="{nid}">{s}</_t>' if mark_text else s)
            continue
        tag = re.sub(r"[^\w.-]", "_", short_name(tag))
        attrs = {"nid": str(nid)}
        for name, value in (cols.attrs[lo + nid] or {}).items():
            name = re.sub(r"[^\w.-]", "_", short_name(name))
            if re.match(r"[A-Za-z_]", name):
                attrs.setdefault(name, value)
        parts.append(f"<{tag}" + "".join(f' {k}="{esc(v)}"' for k, v in attrs.items()) + ">")
        open_tags.append((cols.last[lo + nid], tag))
    parts.extend(f"</{tag}>" for _, tag in reversed(open_tags))
    return "".join(parts)


def _struct_list(offsets: list[int], arrays: list[pa.Array], names: list[str]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, names))


def decompose(
    pages: DataFrame,
    *,
    exclude: Sequence[str] = (),
    keep_tags: Sequence[str] = (),
    xml: bool = False,
    xml_text: bool = False,
    css: Sequence[str] = (),
    body: str = "html",
) -> DataFrame:
    """Replace the ``body`` column by ``nodes`` and ``frags`` (and the XML forms asked for). No shuffle.

    ``css``: selectors that are evaluated here, on the parsed elements; the ids of their nodes are in ``css_column``.
    """
    paths = [path for selector in exclude for path in parse_css(selector)]
    late = any(compound.late for path in paths for _, compound in path)
    css = list(dict.fromkeys(css))
    by_tag: dict[str, list[tuple[int, list]]] = {}
    for number, selector in enumerate(css):
        for path in parse_css(selector):
            by_tag.setdefault(path[-1][1].tag, []).append((number, path))
    keep = frozenset(keep_tags)
    carried = [f for f in pages.schema.fields if f.name != body]
    schema = T.StructType(
        carried
        + [T.StructField("nodes", T.ArrayType(NODE)), T.StructField("frags", T.ArrayType(FRAG))]
        + ([T.StructField("xml", T.StringType())] if xml else [])
        + ([T.StructField("xml_text", T.StringType())] if xml_text else [])
        + [T.StructField(css_column(selector), T.ArrayType(T.IntegerType())) for selector in css]
    )
    names = [f.name for f in carried]
    i32, text_type = pa.int32(), pa.string()

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = _Columns()
        starts, frag_starts = [0], [0]
        plain: list[str] = []
        marked: list[str] = []
        picked: list[list[list[int]]] = [[] for _ in css]
        for html in batch.column(batch.schema.get_field_index(body)).to_pylist():
            opened: list[_Open] | None = [] if css else None
            dropped = _dropped(html or "", paths) if late else frozenset()
            parse_page(html or "", cols, () if late else paths, keep, dropped, opened)
            if css:
                settle(opened, cols, starts[-1], frag_starts[-1])
                found: list[list[int]] = [[] for _ in css]
                for el in opened:
                    for number, path in (*by_tag.get(el.tag, ()), *by_tag.get("*", ())):
                        if (not found[number] or found[number][-1] != el.nid) and matches_path(el, path):
                            found[number].append(el.nid)
                for column, nids_of_page in zip(picked, found):
                    column.append(nids_of_page)
            starts.append(len(cols.parent))
            frag_starts.append(len(cols.frag))
            if xml:
                plain.append(_xml(cols, starts[-2], starts[-1], frag_starts[-2], False))
            if xml_text:
                marked.append(_xml(cols, starts[-2], starts[-1], frag_starts[-2], True))
        nids = [nid for lo, hi in zip(starts, starts[1:]) for nid in range(hi - lo)]
        arrays = [
            pa.array(nids, i32),
            pa.array(cols.parent, i32),
            pa.array(cols.last, i32),
            pa.array(cols.tag, text_type),
            pa.array([list(a.items()) if a else None for a in cols.attrs], pa.map_(text_type, text_type)),
            pa.array(cols.lo, i32),
            pa.array(cols.n, i32),
            pa.array(cols.anchor_in, i32),
            pa.array(cols.anchor_before, i32),
        ]
        frags = [pa.array(cols.frag, text_type), pa.array(cols.keep, text_type)]
        columns = [batch.column(batch.schema.get_field_index(name)) for name in names]
        columns.append(_struct_list(starts, arrays, NODE.names))
        columns.append(_struct_list(frag_starts, frags, FRAG.names))
        columns += [pa.array(plain, text_type)] if xml else []
        columns += [pa.array(marked, text_type)] if xml_text else []
        columns += [pa.array(column, pa.list_(i32)) for column in picked]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # nodes take several times the space of their HTML, so large batches go out in parts
            rows = max(1, min(256, batch.num_rows * (8 << 20) // max(batch.nbytes, 1)))
            for lo in range(0, batch.num_rows, rows):
                yield build(batch.slice(lo, rows))

    return pages.mapInArrow(run, schema)


def frag_text(frags: Column, node: Column, keep_tags: Sequence[str] = ()) -> Column:
    """All text below a node, fragments joined by a space."""
    part = F.slice(frags, node.lo + 1, node.n)
    if not keep_tags:
        return F.array_join(F.transform(part, lambda f: f.s), " ")
    wrapped = F.transform(
        part,
        lambda f: F.when(node.tag.isNull() | f.keep.isNull(), f.s).otherwise(
            F.concat(F.lit("<"), f.keep, F.lit(">"), f.s, F.lit("</"), f.keep, F.lit(">"))
        ),
    )
    return F.array_join(wrapped, " ")


def own_anchor(node: Column) -> Column:
    return F.coalesce(node.attrs["name"], node.attrs["id"])


def node_anchor(nodes: Column, node: Column) -> Column:
    """Anchor of a heading: its own, else the last one inside it, else the nearest one before it or around it."""

    def at(ix: Column) -> Column:
        return own_anchor(F.get(nodes, ix))

    return F.coalesce(F.nullif(own_anchor(node), F.lit("")), at(node.anchor_in), at(node.anchor_before))


def node_rows(decomposed: DataFrame, *keys: str) -> DataFrame:
    """The nodes as a table."""
    return decomposed.select(*keys, F.explode("nodes").alias("node")).select(*keys, "node.*")


def page_links(decomposed: DataFrame, url: str = "url", source: str | None = None) -> DataFrame:
    """Distinct absolute links of every page: ``src_url, dst_url``. Page-local, so no shuffle.

    Relative links start from the page's ``<base>`` when it has one. ``source`` is the URL that a link is said to come
    from, where it is not the one that it is resolved against: of a page that was redirected, the one asked for.
    """
    raw = F.flatten(
        F.transform(
            F.filter("nodes", lambda n: n.tag.isin("a", "area", "iframe")),
            lambda n: F.filter(F.array(n.attrs["href"], n.attrs["src"]), lambda v: v.isNotNull()),
        )
    )
    bases = F.filter("nodes", lambda n: (n.tag == "base") & n.attrs["href"].isNotNull())
    found = decomposed.select(
        F.col(source or url).alias("src_url"), F.col(url).alias("_url"), F.get(bases, F.lit(0)).attrs["href"].alias("_base"), F.explode(F.array_distinct(raw)).alias("_link")
    )
    base = F.when(F.col("_base").isNull(), F.col("_url")).otherwise(resolve_link(F.col("_base"), F.col("_url")))
    return found.withColumn("_base", base).select("src_url", resolve_link(F.col("_link"), F.col("_base")).alias("dst_url"))
