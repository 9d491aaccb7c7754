"""Attributes of a page from URL rules and meta tags, computed once per page and never joined."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrecords.functions.text import json_value, let
from docrecords.functions.urls import first_rule, found, java_regex, starts
from docrecords.spec import StartUrl

MAP = "map<string,string>"


def empty_map() -> Column:
    return F.create_map().cast(MAP)


def overlay(*maps: Column) -> Column:
    """Merge maps, later ones win. Does not depend on the session's duplicate-key policy."""
    out = maps[0]
    for upper in maps[1:]:
        out = let(
            F.struct(out.alias("a"), upper.alias("b")),
            lambda p: F.map_concat(F.map_filter(p.a, lambda k, _: ~F.map_contains_key(p.b, k)), p.b),
        )
    return out


def selector_key(url: Column, rules: Sequence[StartUrl]) -> Column:
    """Selector set of a page: that of the first rule found in the URL."""
    return _lookup(first_rule(url, [r.url for r in rules], found), [F.lit(r.selectors_key) for r in rules], F.lit("default"))


def page_rank(url: Column, rules: Sequence[StartUrl]) -> Column:
    return _lookup(first_rule(url, [r.url for r in rules], starts), [F.lit(r.page_rank) for r in rules], F.lit(0)).cast("int")


def page_tags(url: Column, rules: Sequence[StartUrl]) -> Column:
    none = F.array().cast("array<string>")
    tags = [F.array(*[F.lit(t) for t in r.tags]).cast("array<string>") for r in rules]
    return _lookup(first_rule(url, [r.url for r in rules], starts), tags, none)


def extra_attributes(url: Column, rules: Sequence[StartUrl]) -> Column:
    """Attributes of the first matching rule that has some, values as JSON."""
    rules = [r for r in rules if r.extra_attributes is not None]
    maps = []
    for rule in rules:
        pairs = [F.lit(x) for k, v in rule.extra_attributes.items() for x in (k, json.dumps(v, ensure_ascii=False))]
        maps.append(F.create_map(*pairs).cast(MAP))
    return _lookup(first_rule(url, [r.url for r in rules], starts), maps, empty_map())


def _lookup(index: Column, values: Sequence[Column], default: Column) -> Column:
    if not values:
        return default
    return F.coalesce(F.get(F.array(*values), index), default)


def url_variables(url: Column, rules: Sequence[StartUrl]) -> Column:
    """Fold over all rules with variables, in order: ``struct<url, vars>``.

    A rule found in the running URL adds its values and deletes their text from the URL that later rules see.
    """
    rules = [r for r in rules if r.url_attributes]
    start = F.struct(url.alias("url"), empty_map().alias("vars"))
    if not rules:
        return start
    table = F.array(
        *[
            F.struct(
                F.lit(java_regex(r.url)).alias("re"),
                F.array(
                    *[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in r.url_attributes.items()]
                ).alias("vars"),
            )
            for r in rules
        ]
    )

    def put(acc: Column, var: Column) -> Column:
        without = F.when(var.v == "", acc.url).otherwise(F.replace(acc.url, var.v, F.lit("")))
        kept = F.map_filter(acc.vars, lambda k, _: k != var.k)
        return F.struct(without.alias("url"), F.map_concat(kept, F.create_map(var.k, json_value(var.v))).alias("vars"))

    def step(acc: Column, rule: Column) -> Column:
        # the pattern is tested once per rule, the deletions happen afterwards
        hit = F.regexp_like(acc.url, rule.re)
        return F.when(hit, F.aggregate(rule.vars, acc, put)).otherwise(acc)

    return F.aggregate(table, start, step)


def meta_attributes(nodes: Column, prefix: str) -> Column:
    """``<meta name="PREFIX...">`` values as JSON, the last one of a name wins."""
    tags = F.filter(
        nodes,
        lambda n: (n.tag == "meta") & F.startswith(n.attrs["name"], F.lit(prefix)) & (n.attrs["content"] != ""),
    )
    pairs = F.transform(
        tags,
        lambda n: F.struct(
            F.replace(n.attrs["name"], F.lit(prefix), F.lit("")).alias("k"), n.attrs["content"].alias("c")
        ),
    )

    def last_of_name(found_pairs: Column) -> Callable:
        def test(p: Column, ix: Column) -> Column:
            later = F.slice(found_pairs, ix + 2, F.size(found_pairs))
            return ~F.exists(later, lambda q: q.k == p.k)

        return test

    unique = let(pairs, lambda found_pairs: F.filter(found_pairs, last_of_name(found_pairs)))
    return F.map_from_entries(F.transform(unique, lambda p: F.struct(p.k.alias("k"), meta_json(p.k, p.c).alias("v"))))


def meta_json(name: Column, content: Column) -> Column:
    """Meta content as JSON: kept as it is when it is JSON and not empty or false, else a JSON string."""
    text = F.btrim(content, F.lit(" \t\r\n"))

    def choose(kind: Column) -> Column:
        empty = (
            (kind == "VOID")
            | text.isin("false", '""')
            | text.rlike(r"^\[\s*\]$|^\{\s*\}$|^-?0+(\.0*)?([eE][+-]?\d+)?$")
        )
        valid = F.coalesce(~empty, F.lit(False))
        version = (
            F.when(~valid, json_value(content))
            .when(kind == "STRING", text)
            .when(kind == "BOOLEAN", F.lit('"True"'))
            .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), json_value(text.try_cast("double").cast("string")))
            .otherwise(json_value(text))
        )
        return F.when(name == "version", version).otherwise(F.when(valid, text).otherwise(json_value(content)))

    # null when the content is not JSON
    return let(F.schema_of_variant(F.try_parse_json(content)), choose)
