"""Pages to search records in one plan.

Everything page-local (selection, texts, anchors, page attributes) is computed inside the page's row right after
decomposition, so neither the HTML nor the nodes are ever shuffled. Only the matched rows move, once, to carry headings
down; a page's matches cannot outgrow its HTML, which is a single input value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecords.operators import hierarchy as H
from docrecords.operators import page_attrs as P
from docrecords.operators.decompose import decompose
from docrecords.operators.select import css_selectors, level_matches, page_text, page_value_json, xml_columns
from docrecords.spec import LEVELS, SelectorSet, Spec

SET = "selectors_key"


def drop_stop_content(pages: DataFrame, phrases, body: str = "html") -> DataFrame:
    """Pages that contain any stop phrase give no records."""
    for phrase in phrases:
        pages = pages.filter(~F.contains(F.col(body), F.lit(phrase)))
    return pages


def _per_set(spec: Spec, value: Callable[[SelectorSet], Column]) -> Column:
    """The value of a page's selector set; unknown keys use ``default``."""
    sets = list(spec.selectors.values())
    if len(sets) == 1 and "default" in spec.selectors:
        return value(sets[0])
    named = [group for group in sets if group.key != "default"]
    out = F.when(F.col(SET) == named[0].key, value(named[0]))
    for group in named[1:]:
        out = out.when(F.col(SET) == group.key, value(group))
    if "default" in spec.selectors:
        return out.otherwise(value(spec.selectors["default"]))
    return out.otherwise(F.raise_error(F.concat(F.lit("no selectors for "), F.col("url"), F.lit(", and no default ones"))))


def parse_pages(pages: DataFrame, spec: Spec) -> DataFrame:
    """Decompose the pages that pass the stop phrases, with the XML forms that the selectors need."""
    need = xml_columns(list(spec.selectors.values()))
    kept = [c for c in ("page_id", "url", "from_sitemap", "html") if c in pages.columns]
    return decompose(
        drop_stop_content(pages.select(*kept), spec.stop_content),
        exclude=spec.selectors_exclude,
        keep_tags=spec.keep_tags,
        xml="xml" in need,
        xml_text="xml_text" in need,
        css=css_selectors(list(spec.selectors.values())),
    )


def page_attributes(parsed: DataFrame, spec: Spec) -> DataFrame:
    """One row per page: rule attributes, page-wide texts and extra values, plus the page-local columns."""
    url, rules = F.col("url"), spec.start_urls
    out = parsed.withColumns(
        {
            SET: P.selector_key(url, rules),
            "page_rank": P.page_rank(url, rules),
            "tags": P.page_tags(url, rules),
            "_vars": P.url_variables(url, rules),
        }
    )

    def globals_of(group: SelectorSet) -> Column:
        texts = []
        for k, name in enumerate(LEVELS):
            sel = group.page_wide.get(name)
            texts.append(F.lit(None).cast("string") if sel is None else page_text(sel, spec.strip_chars, spec.keep_tags))
        return F.array(*texts)

    def extras_of(group: SelectorSet) -> Column:
        if not group.extras:
            return P.empty_map()
        pairs = []
        for name in group.extras:
            pairs += [F.lit(name), page_value_json(group.selectors[name], spec.strip_chars, spec.keep_tags)]
        return F.create_map(*pairs)

    has_globals = any(set(group.page_wide) & set(LEVELS) for group in spec.selectors.values())
    parts = [P.extra_attributes(url, rules)] if any(r.extra_attributes for r in rules) else []
    if any(group.extras for group in spec.selectors.values()):
        parts.append(_per_set(spec, extras_of))
    parts.append(P.meta_attributes(F.col("nodes"), spec.meta_prefix))
    if any(r.url_attributes for r in rules):
        parts.append(F.col("_vars.vars"))
    columns = {"extras": P.overlay(*parts), "bare_url": F.col("_vars.url")}
    if has_globals:
        columns["globals"] = _per_set(spec, globals_of)
    return out.withColumns(columns).drop("_vars")


def match_rows(parsed: DataFrame, spec: Spec) -> DataFrame:
    """One row per matched node, numbered in document order before any filter."""
    with_attrs = _has_level_attrs(spec)
    matches = _per_set(
        spec, lambda group: level_matches(group, spec.strip_chars, spec.keep_tags, attrs=with_attrs)
    )
    page_local = {"nodes", "frags", "xml", "xml_text"}
    carried = [c for c in parsed.columns if c not in page_local and not c.startswith("_css_")]
    return parsed.select(*carried, F.posexplode(matches).alias("position", "m")).select(*carried, "position", "m.*")


def _has_level_attrs(spec: Spec) -> bool:
    return any(s.attributes for group in spec.selectors.values() for s in group.selectors.values())


def shape_records(rows: DataFrame, spec: Spec, filled: bool = False) -> DataFrame:
    """Matched rows with page attributes to records: fill-down, filters, globals, defaults, weights, URLs and ids."""
    with_attrs = _has_level_attrs(spec)
    heading_count = _per_set(spec, lambda g: F.lit(g.heading_count))
    # content rows set no state and are numbered already, so empty ones need not travel
    rows = H.drop_empty_content(rows)
    if not filled:
        deepest_used = max(group.heading_count for group in spec.selectors.values())
        rows = H.fill_down(rows, ["page_id"], "position", attrs=with_attrs, levels=deepest_used)
    if spec.only_content_level:
        rows = H.keep_content_only(rows)
    min_level = (
        F.lit(spec.min_level_for("default"))
        if set(spec.min_indexed_level) == {"default"}
        else _min_level(spec)
    )
    rows = H.keep_min_level(rows, min_level, heading_count)

    if "globals" in rows.columns:
        index = H.level_index(F.col("lvl"), heading_count)
        fills = {}
        for k, name in enumerate(LEVELS):
            owners = [g for g in spec.selectors.values() if name in g.page_wide and name in g.used_levels]
            if owners:
                is_global = _per_set(spec, lambda g, n=name: F.lit(n in g.page_wide and n in g.used_levels))
                fills[name] = F.when(is_global & (index >= k), F.get("globals", F.lit(k))).otherwise(F.col(name))
        rows = rows.withColumns(fills)

    def has_attrs(k: int) -> Column:
        return F.map_contains_key("level_attrs", LEVELS[k]) if with_attrs else F.lit(False)

    defaults = {}
    for k, name in enumerate(LEVELS):
        if any(name in g.selectors and g.selectors[name].default_value is not None for g in spec.selectors.values()):
            value = _per_set(spec, lambda g, n=name: _default(g, n))
            defaults[name] = F.when(has_attrs(k), F.col(name)).otherwise(F.coalesce(F.col(name), value))
    rows = rows.withColumns(defaults) if defaults else rows
    content_default = _per_set(spec, lambda g: _default(g, "content"))
    content = F.coalesce(F.when(F.col("lvl") == H.CONTENT, F.col("text")), content_default)

    deepest = H.deepest_level(lambda k: F.col(LEVELS[k]).isNotNull() | has_attrs(k), heading_count)
    radio = H.radio_levels(F.col("_deepest"), F.col("lvl"))
    anchored = F.col("anchor").isNotNull() & F.lit(not (spec.js_render and spec.use_anchors))

    def with_anchor(url: Column) -> Column:
        return F.when(anchored, F.concat(url, F.lit("#"), F.col("anchor"))).otherwise(url)

    out = rows.withColumn("_deepest", deepest).select(
        "page_id",
        with_anchor(F.col("url")).alias("url"),
        F.col("url").alias("url_without_anchor"),
        with_anchor(F.col("bare_url")).alias("url_without_variables"),
        (with_anchor(F.col("url")) == with_anchor(F.col("bare_url"))).alias("no_variables"),
        "anchor",
        content.alias("content"),
        F.struct(*LEVELS).alias("hierarchy"),
        F.struct(*[c.alias(name[len("radio_"):]) for name, c in radio.items()]).alias("hierarchy_radio"),
        H.level_type(F.col("lvl")).alias("type"),
        "tags",
        F.struct("page_rank", H.heading_weight(F.col("lvl")).alias("level"), "position").alias("weight"),
        "extras",
        *[c for c in ("level_attrs", "from_sitemap") if c in rows.columns],
    )
    fillable = [name for name in LEVELS if any(_can_be_set(group, name) for group in spec.selectors.values())]
    level = {name: F.col("hierarchy")[name] for name in fillable}
    attrs = {name: F.col("level_attrs")[name] for name in fillable} if with_attrs else None
    return out.withColumn("objectID", H.object_id(level, F.col("weight.position"), F.col("url"), attrs))


def _can_be_set(group: SelectorSet, name: str) -> bool:
    sel = group.selectors.get(name)
    return name in group.used_levels or (sel is not None and sel.default_value is not None)


def _default(group: SelectorSet, name: str) -> Column:
    sel = group.selectors.get(name)
    return F.lit(sel.default_value if sel else None).cast("string")


def _min_level(spec: Spec) -> Column:
    out = None
    for key, level in spec.min_indexed_level.items():
        if key != "default":
            test = F.col(SET) == key
            out = F.when(test, F.lit(level)) if out is None else out.when(test, F.lit(level))
    if "default" in spec.min_indexed_level:
        return out.otherwise(F.lit(spec.min_level_for("default")))
    # only pages that need the missing level fail
    return out.otherwise(F.raise_error(F.concat(F.lit("no minimum level for selectors "), F.col(SET))).cast("int"))


def build_records(pages: DataFrame, spec: Spec) -> DataFrame:
    """``pages(page_id, url, html)`` to records. ``page_id`` must be unique."""
    return shape_records(match_rows(page_attributes(parse_pages(pages, spec), spec), spec), spec)
