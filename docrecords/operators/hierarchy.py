"""From ordered matches to hierarchy columns.

Input rows have a group (the page), an order column and ``lvl`` (0 to 6 for headings, 7 for content), ``text`` and
``anchor``. The same operators serve decomposed pages and any table of that shape.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecords.functions.text import json_text, let
from docrecords.operators.prefix import running
from docrecords.spec import CONTENT, LEVELS

MAX_LEVEL = len(LEVELS)


def add_position(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "position", large: bool = False
) -> DataFrame:
    """0-based index among all matches of the group."""
    df = running(df, keys, order, sums={name: F.lit(1)}, large=large)
    return df.withColumn(name, F.col(name).cast("int"))


def fill_down(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    large: bool = False,
    attrs: bool = False,
    position: str | None = None,
    levels: int = MAX_LEVEL,
) -> DataFrame:
    """Carry headings down: adds ``lvl0..lvl6`` and the record ``anchor`` (deepest level first).

    With ``position`` the rows are numbered in the same pass, see :func:`add_position`. ``levels`` is the number of
    heading levels in use; deeper ones are null.

    A heading sets its level and clears the deeper ones, also when its text is null. For level k the latest heading at
    k or above decides: the level is filled only if that heading is at k itself.
    """
    kept = ["lvl", "text", "anchor"] + (["attrs"] if attrs else [])
    states = {f"_s{k}": F.when(F.col("lvl") <= k, F.struct(*kept)) for k in range(levels)}
    numbers = {position: F.lit(1)} if position else {}
    df = running(df, keys, order, sums=numbers, lasts=states, large=large)

    def held(k: int, part: str) -> Column:
        state = F.col(f"_s{k}")
        return F.when(state["lvl"] == k, state[part])

    none = F.lit(None).cast("string")
    out = {name: held(k, "text") if k < levels else none for k, name in enumerate(LEVELS)}
    out["anchor"] = F.coalesce(*[held(k, "anchor") for k in range(levels - 1, -1, -1)], none)
    if attrs:
        out["level_attrs"] = F.map_filter(
            F.create_map(*[c for k, name in enumerate(LEVELS[:levels]) for c in (F.lit(name), held(k, "attrs"))]),
            lambda _, v: v.isNotNull(),
        )
    if position:
        out[position] = F.col(position).cast("int")
    return df.withColumns(out).drop(*states)


def level_index(lvl: Column, heading_count: Column) -> Column:
    """Index in the list of used levels: content comes after the headings."""
    return F.when(lvl == CONTENT, heading_count).otherwise(lvl)


def level_type(lvl: Column) -> Column:
    return F.when(lvl == CONTENT, F.lit("content")).otherwise(F.concat(F.lit("lvl"), lvl.cast("string")))


def heading_weight(lvl: Column) -> Column:
    """:func:`docrecords.functions.text.level_weight` from the level number."""
    return F.when(lvl == CONTENT, F.lit(0)).otherwise(F.lit(100) - F.lit(10) * lvl).cast("int")


def keep_content_only(df: DataFrame) -> DataFrame:
    """Headings have set the hierarchy by now and give no record."""
    return df.filter(F.col("lvl") == CONTENT)


def keep_min_level(df: DataFrame, min_level: Column, heading_count: Column) -> DataFrame:
    return df.filter(level_index(F.col("lvl"), heading_count) >= min_level)


def drop_empty_content(df: DataFrame) -> DataFrame:
    return df.filter((F.col("lvl") != CONTENT) | F.coalesce(F.col("text") != "", F.lit(False)))


def deepest_level(is_set: Callable[[int], Column], heading_count: Column) -> Column:
    """Number of the deepest filled level in use, null for none."""
    return F.greatest(*[F.when(is_set(k) & (heading_count > k), F.lit(k)) for k in range(MAX_LEVEL)])


def radio_levels(deepest: Column, lvl: Column) -> dict[str, Column]:
    """Only the deepest level stays; content rows keep none."""
    keep = lvl != CONTENT
    return {f"radio_{name}": F.when(keep & (deepest == k), F.col(name)) for k, name in enumerate(LEVELS)}


def attrs_json(attrs: Column) -> Column:
    """JSON object of an attribute map, keys sorted."""
    pairs = F.transform(
        F.array_sort(F.map_entries(attrs)), lambda e: F.concat(json_text(e.key), F.lit(": "), json_text(e.value))
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def object_id(
    levels: Mapping[str, Column], position: Column, url: Column, attrs: Mapping[str, Column] | None = None
) -> Column:
    """Record id: SHA-1 over the JSON of hierarchy (null levels left out), position and URL.

    ``attrs`` gives, per level, the attribute map that stands in for its text when not null.
    """

    def digest(texts: Column) -> Column:
        pairs = []
        for k, (name, value) in enumerate(levels.items()):
            pair = F.when(value.isNotNull(), F.concat(F.lit(f'"{name}": '), F.get(texts, F.lit(k))))
            if attrs:
                inner = F.concat(F.lit(f'"{name}": '), attrs_json(attrs[name]))
                pair = F.when(attrs[name].isNotNull(), inner).otherwise(pair)
            pairs.append(pair)
        return F.sha1(
            F.concat(
                F.lit('{"hierarchy_to_hash": {'),
                F.concat_ws(", ", *pairs),
                F.lit('}, "position": '),
                position.cast("string"),
                F.lit(', "url": '),
                F.get(texts, F.lit(len(levels))),
                F.lit("}"),
            )
        )

    return let(F.transform(F.array(*levels.values(), url), json_text), digest)
