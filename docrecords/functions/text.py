"""Text functions on Columns. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Characters that become entities in indexed text.
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}

# JSON short escapes.
JSON_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it in ``body``.

    A projection that is referenced once gets inlined by the optimizer, also into a lambda where it would run for
    every element. A lambda variable cannot be inlined, so this evaluates ``value`` once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_text(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def strip_text(col: Column, chars: str | None = None) -> Column:
    """Strip white space, then once ``chars``; empty text becomes null."""
    out = F.btrim(col, F.lit(WHITESPACE))
    if chars:
        out = F.btrim(out, F.lit(chars))
    return F.nullif(out, F.lit(""))


def escape_text(col: Column, keep_tags: Sequence[str] = ()) -> Column:
    """Turn markup characters into entities, except ``&`` and the tags to keep."""
    if not keep_tags:
        # an ampersand is written as an entity and restored at the end, so it can be left alone
        for char, entity in ENTITIES.items():
            if char != "&":
                col = replace_text(col, char, entity)
        return col
    for char, entity in ENTITIES.items():
        col = replace_text(col, char, entity)
    for tag in keep_tags:
        for markup in (f"<{tag}>", f"</{tag}>"):
            hidden = markup.replace("<", "&lt;").replace(">", "&gt;")
            col = replace_text(col, hidden, markup)
    return replace_text(col, "&amp;", "&")


def clean_text(col: Column, chars: str | None = None, keep_tags: Sequence[str] = ()) -> Column:
    return escape_text(strip_text(col, chars), keep_tags)


def strip_built(col: Column, chars: str | None = None) -> Column:
    """:func:`strip_text` for a text that is costly to build: it is built once, also inside a lambda."""
    out = F.btrim(col, F.lit(WHITESPACE))
    if chars:
        out = F.btrim(out, F.lit(chars))
    return let(out, lambda t: F.nullif(t, F.lit("")))


def join_texts(texts: Column, keep_tags: Sequence[str] = ()) -> Column:
    """Join an array of cleaned texts by one space; nulls are left out, nothing gives null."""
    return escape_text(let(F.array_join(texts, " "), lambda t: F.nullif(t, F.lit(""))), keep_tags)


def json_text(col: Column) -> Column:
    """JSON string with every non-ASCII character written as ``\\uXXXX``; null becomes ``null``."""
    plain = col.rlike(r"^[\x20-\x21\x23-\x5b\x5d-\x7e]*$")
    escaped = F.to_json(F.array(col), {"writeNonAsciiCharacterAsCodePoint": "true"})
    escaped = F.substring(escaped, F.lit(2), F.length(escaped) - 2)
    # hex digits of the escapes are lower case here, and DEL is escaped too
    pieces = F.split(F.replace(escaped, F.lit("\x7f"), F.lit(r"\u007f")), r"\\u")

    def lower_digits(piece: Column, ix: Column) -> Column:
        rest = F.substring(piece, F.lit(5), F.length(piece))
        return F.when(ix == 0, piece).otherwise(F.concat(F.lower(F.substring(piece, 1, 4)), rest))

    lower = F.array_join(F.transform(pieces, lower_digits), r"\u")
    return (
        F.when(col.isNull(), F.lit("null"))
        .when(plain, F.concat(F.lit('"'), col, F.lit('"')))
        .when(F.contains(col, F.lit("\\")), _json_by_char(col))
        .otherwise(lower)
    )


def _json_by_char(col: Column) -> Column:
    """The same, character by character; for text with backslashes, where an escape is hard to tell from text."""

    def one(char: Column) -> Column:
        out = F.when(char.rlike(r"^[\x20-\x21\x23-\x5b\x5d-\x7e]$"), char)
        for plain, escaped in JSON_ESCAPES.items():
            out = out.when(char == F.lit(plain), F.lit(escaped))
        units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
        return out.otherwise(F.regexp_replace(units, F.lit("(.{4})"), F.lit(r"\\u$1")))

    return F.concat(F.lit('"'), F.array_join(F.transform(F.split(col, ""), one), ""), F.lit('"'))


def json_value(col: Column) -> Column:
    """Plain JSON string of a text column, non-ASCII kept; null becomes ``null``."""
    quoted = F.to_json(F.array(col))
    return F.when(col.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def level_weight(type_col: Column) -> Column:
    """100 for lvl0, ten less per level, 0 for everything else."""
    digits = F.regexp_extract(type_col, r"^lvl(\d+)", 1)
    return F.when(digits != "", F.lit(100) - F.lit(10) * digits.cast("int")).otherwise(F.lit(0)).cast("int")


def restore_apostrophes(col: Column) -> Column:
    return replace_text(col, ENTITIES["'"], "'")


def flag_text(col: Column) -> Column:
    """Booleans are stored as ``True`` / ``False`` in the index."""
    return F.initcap(col.cast("string"))
