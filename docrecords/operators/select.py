"""Selectors evaluated on decomposed pages, page by page inside the row."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrecords.functions.text import escape_text, join_texts, json_value, let, strip_built
from docrecords.operators.css import css_column, css_to_xpath, simple_compounds
from docrecords.operators.decompose import LONGEST_NAME, frag_text, node_anchor, short_name
from docrecords.spec import CONTENT, Selector, SelectorSet

_TEXT_STEP = re.compile(r"text\(\)((?:\[[^\]]*\])*)\s*(?=$|\|)")
_SCALAR = {
    "number": F.xpath_number,
    "string": F.xpath_string,
    "boolean": F.xpath_boolean,
}
# XPath functions by the type of their result.
_SCALAR_FUNCTIONS = {
    "number": ("count", "number", "sum", "string-length", "floor", "ceiling", "round"),
    "string": ("string", "concat", "normalize-space", "substring", "substring-before", "substring-after", "translate"),
    "boolean": ("boolean", "not", "contains", "starts-with", "true", "false"),
}


def scalar_kind(sel: Selector) -> str | None:
    """Type of an XPath that gives a value instead of nodes, from its outer function."""
    outer = re.match(r"\s*([a-z-]+)\s*\(", sel.selector)
    if sel.type != "xpath" or not outer:
        return None
    return next((kind for kind, names in _SCALAR_FUNCTIONS.items() if outer[1] in names), None)


def _needs(sel: Selector) -> str | None:
    """Column an XPath runs on: ``xml``, ``xml_text`` or None when no XPath is needed."""
    if not sel.selector or sel.type == "css":
        return None
    return "xml_text" if _TEXT_STEP.search(sel.selector) else "xml"


def _all_selectors(sets: Sequence[SelectorSet]) -> list[Selector]:
    selectors = [s for group in sets for s in group.selectors.values()]
    return selectors + [inner for s in selectors for inner in (s.attributes or {}).values()]


def xml_columns(sets: Sequence[SelectorSet]) -> set[str]:
    # a level with sub-selectors may be used as the start of a path
    return {need for s in _all_selectors(sets) for need in [_needs(s)] if need}


def css_selectors(sets: Sequence[SelectorSet]) -> list[str]:
    """Selectors that are evaluated while a page is parsed: CSS with combinators or pseudo-classes."""
    found = [s.selector for s in _all_selectors(sets) if s.type == "css" and s.selector]
    return [css for css in dict.fromkeys(found) if not simple_compounds(css)]


def _union_parts(xpath: str) -> list[str]:
    """The parts of a union; bars in brackets, parentheses and quotes do not separate."""
    parts, depth, quote, start = [], 0, "", 0
    for at, c in enumerate(xpath):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and not depth:
            parts.append(xpath[start:at])
            start = at + 1
    return [p.strip() for p in [*parts, xpath[start:]]]


def _absolute(xpath: str) -> str:
    """Relative paths start at the root element."""
    return " | ".join(p if p.startswith(("/", "(")) else "/*/" + p for p in _union_parts(xpath))


_ATTRIBUTE = re.compile(r"(?P<path>.*?)/(?:@|attribute::)(?P<name>[\w:.-]+)\s*$", re.S)
_OPERATOR = re.compile(r"\band\b|\bor\b|[=<>+*|(\[/@]|::")
# the XPath engine takes some 100 operators in one expression
OPERATORS = 60


def xpath_parts(sel: Selector) -> list[tuple[str, str | None]]:
    """Parts of an XPath that gives nodes: the path of elements, and the attribute that is taken of them."""
    xpath = re.sub(rf"[\w.-]{{{LONGEST_NAME + 1},}}", lambda m: short_name(m[0]), sel.selector)
    out = []
    for part in _union_parts(xpath):
        m = _ATTRIBUTE.match(part)
        name = m["name"].lower() if m else None
        out.append((_absolute(f"{m['path']}[@{name}]" if m else part), name))
    return out


def _xpath_nids(paths: Sequence[str], source: str) -> Column:
    """Ids of the nodes of all paths, in document order; paths share a call as far as the engine takes them."""
    calls: list[list[str]] = []
    room = 0
    for path in paths:
        cost = 1 + len(_OPERATOR.findall(path))
        if not calls or cost > room:
            calls.append([])
            room = OPERATORS
        calls[-1].append(path)
        room -= cost
    found = []
    for call in calls:
        xpath = " | ".join(call)
        if source == "xml_text":
            xpath = _TEXT_STEP.sub(r"_t\1", xpath)
        found.append(F.xpath(F.col(source), F.lit(f"({xpath})/@nid")).cast("array<int>"))
    return found[0] if len(found) == 1 else F.array_sort(F.array_distinct(F.concat(*found)))


def select_nids(sel: Selector, nodes: Column | None = None) -> Column:
    """Ids of the selected nodes in document order, without duplicates; of a selected attribute, its element's."""
    nodes = F.col("nodes") if nodes is None else nodes
    if not sel.selector:
        return F.array().cast("array<int>")
    compounds = simple_compounds(sel.selector) if sel.type == "css" else None
    if compounds:
        test = lambda n: reduce(lambda a, b: a | b, [c.matches_node(n) for c in compounds])
        return F.transform(F.filter(nodes, test), lambda n: n.nid)
    if sel.type == "css":
        return F.col(css_column(sel.selector))
    return _xpath_nids([path for path, _ in xpath_parts(sel)], _needs(sel))


def attribute_of(sel: Selector) -> str | None:
    """The attribute that a selector takes of its nodes, if it is one and the same for all of them."""
    names = {name for _, name in xpath_parts(sel)} if sel.type == "xpath" and sel.selector else {None}
    return names.pop() if len(names) == 1 else None


def node_text(node: Column, chars: str | None, keep_tags: Sequence[str] = (), frags: Column | None = None) -> Column:
    text = frag_text(F.col("frags") if frags is None else frags, node, keep_tags)
    return escape_text(strip_built(text, chars), keep_tags)


def texts_of(nids: Column, chars: str | None, keep_tags: Sequence[str] = ()) -> Column:
    """One text from many nodes."""
    texts = F.transform(nids, lambda i: node_text(F.get(F.col("nodes"), i), chars, keep_tags))
    return join_texts(texts, keep_tags)


def _own_texts(sel: Selector, chars: str | None, keep_tags: Sequence[str]) -> Column:
    """Texts of nodes and values of attributes, in document order."""
    by_name: dict[str | None, list[str]] = {}
    for path, name in xpath_parts(sel):
        by_name.setdefault(name, []).append(path)

    def text_of(name: str | None) -> Callable[[Column], Column]:
        def text(nid: Column) -> Column:
            node = F.get(F.col("nodes"), nid)
            value = node_text(node, chars, keep_tags) if name is None else escape_text(strip_built(node.attrs[name], chars), keep_tags)
            return F.struct(nid.alias("nid"), value.alias("text"))

        return text

    found = [F.transform(_xpath_nids(paths, _needs(sel)), text_of(name)) for name, paths in by_name.items()]
    ordered = found[0] if len(found) == 1 else F.array_sort(F.concat(*found))
    return F.transform(ordered, lambda x: x["text"])


def selected_text(sel: Selector, chars: str | None, keep_tags: Sequence[str] = ()) -> Column:
    """One text of all that a selector gives: nodes, attributes or a value."""
    kind = scalar_kind(sel)
    if kind is not None:
        value = _SCALAR[kind](F.col("xml"), F.lit(sel.selector)).cast("string")
        return escape_text(strip_built(value, chars), keep_tags)
    if sel.type == "xpath" and sel.selector and any(name for _, name in xpath_parts(sel)):
        return join_texts(_own_texts(sel, chars, keep_tags), keep_tags)
    return texts_of(select_nids(sel), chars, keep_tags)


def page_text(sel: Selector, strip_chars: str, keep_tags: Sequence[str] = ()) -> Column:
    """Page-wide text of a selector, else its default."""
    chars = strip_chars if sel.strip_chars is None else sel.strip_chars
    text = selected_text(sel, chars, keep_tags)
    return text if sel.default_value is None else F.coalesce(text, F.lit(sel.default_value))


def page_value_json(sel: Selector, strip_chars: str, keep_tags: Sequence[str] = ()) -> Column:
    """Page-wide value of a selector as JSON; XPath that yields a number, string or flag is returned unchanged."""
    kind = scalar_kind(sel)
    if kind is None:
        return json_value(page_text(sel, strip_chars, keep_tags))
    value = _SCALAR[kind](F.col("xml"), F.lit(sel.selector))
    return json_value(value) if kind == "string" else value.cast("string")


def _sub_nids(name: str, sub: Selector, level: Selector) -> tuple[str, Column, bool]:
    """Nodes of a sub-selector on the whole page, and whether they are limited to the subtree of the level node."""
    if sub.type == "xpath" and not sub.selector.startswith("/"):
        start = css_to_xpath(level.selector) if level.type == "css" else level.selector
        xpath = f"({_absolute(start)})/{sub.selector}"
        return name, F.xpath(F.col("xml"), F.lit(f"({xpath})/@nid")).cast("array<int>"), True
    return name, select_nids(sub), sub.type == "css"


def level_matches(
    group: SelectorSet, strip_chars: str, keep_tags: Sequence[str] = (), anchors: bool = True, attrs: bool = False
) -> Column:
    """Matched nodes of all used, non-global levels: ``array<struct<nid, lvl, text, anchor[, attrs]>>``.

    A node that several levels select belongs to the shallowest of them, content last.
    """
    nodes = F.col("nodes")
    levels = [
        (CONTENT if name == "content" else int(name[3:]), name, group.selectors[name])
        for name in group.used_levels
        if not group.selectors[name].is_global and group.selectors[name].selector
    ]
    plain = all(s.type == "css" and simple_compounds(s.selector) for _, _, s in levels)
    if not levels:
        found = F.array().cast("array<struct<nid:int,lvl:int>>")
    elif plain:

        def level_of(node: Column) -> Column:
            out = None
            for lvl, _, sel in levels:
                test = reduce(lambda a, b: a | b, [c.matches_node(node) for c in simple_compounds(sel.selector)])
                out = F.when(test, F.lit(lvl)) if out is None else out.when(test, F.lit(lvl))
            return out

        marked = F.transform(nodes, lambda n: F.struct(n.nid.alias("nid"), level_of(n).alias("lvl")))
        found = F.filter(marked, lambda m: m.lvl.isNotNull())
    else:
        def at_level(lvl: int):
            return lambda nid: F.struct(nid.alias("nid"), F.lit(lvl).alias("lvl"))

        hits = [F.transform(select_nids(sel), at_level(lvl)) for lvl, _, sel in levels]
        found = let(
            F.array_sort(F.concat(*hits)),
            lambda all_hits: F.filter(
                all_hits, lambda m, ix: (ix == 0) | (m.nid != F.get(all_hits, ix - 1).nid)
            ),
        )

    taken = {lvl: name for lvl, _, sel in levels for name in [attribute_of(sel)] if name}

    def text_of(m: Column, node: Column) -> Column:
        raw = frag_text(F.col("frags"), node, keep_tags)
        for lvl, attribute in taken.items():
            raw = F.when(m.lvl == lvl, node.attrs[attribute]).otherwise(raw)
        chars = {lvl: group.strip_for(name, strip_chars) for lvl, name, _ in levels}
        if len(set(chars.values())) <= 1:
            stripped = strip_built(raw, next(iter(chars.values()), strip_chars))
        else:
            stripped = let(raw, lambda t: _by_level(m.lvl, {k: strip_built(t, c) for k, c in chars.items()}))
        return escape_text(stripped, keep_tags)

    subs: Mapping[int, list] = {
        lvl: [_sub_nids(name, sub, sel) for name, sub in sel.attributes.items()]
        for lvl, _, sel in levels
        if sel.attributes and lvl != CONTENT
    }
    names = {(lvl, name): f"s{lvl}_{i}" for lvl, found_subs in subs.items() for i, (name, _, _) in enumerate(found_subs)}

    def attrs_of(m: Column, node: Column, shared: Column) -> Column:
        out = {}
        for lvl, group_subs in subs.items():
            pairs = []
            for name, _, inside in group_subs:
                sub = group.selectors[f"lvl{lvl}"].attributes[name]
                nids = shared[names[lvl, name]]
                if inside:
                    nids = F.filter(nids, lambda i: (i >= node.nid) & (i <= node.last))
                chars = strip_chars if sub.strip_chars is None else sub.strip_chars
                pairs += [F.lit(name), texts_of(nids, chars, keep_tags)]
            out[lvl] = F.create_map(*pairs)
        return _by_level(m.lvl, out, F.lit(None).cast("map<string,string>"))

    def describe(m: Column, shared: Column | None) -> Column:
        def fields(node: Column) -> Column:
            text = text_of(m, node)
            if subs:
                text = F.when(~m.lvl.isin(*subs), text)
            out = [m.nid.alias("nid"), m.lvl.alias("lvl"), text.alias("text")]
            anchor = node_anchor(nodes, node) if anchors else F.lit(None).cast("string")
            heading = (m.lvl != CONTENT) & node.tag.isNotNull()
            out.append(F.when(heading, anchor).alias("anchor"))
            if attrs:
                extra = attrs_of(m, node, shared) if subs else F.lit(None).cast("map<string,string>")
                out.append(extra.alias("attrs"))
            return F.struct(*out)

        return let(F.get(nodes, m.nid), fields)

    if not subs:
        return F.transform(found, lambda m: describe(m, None))
    bundle = F.struct(*[nids.alias(names[lvl, name]) for lvl, g in subs.items() for name, nids, _ in g])
    return let(bundle, lambda shared: F.transform(found, lambda m: describe(m, shared)))


def _by_level(lvl: Column, values: Mapping[int, Column], other: Column | None = None) -> Column:
    out = None
    for k, value in values.items():
        out = F.when(lvl == k, value) if out is None else out.when(lvl == k, value)
    return out if other is None else out.otherwise(other)
