"""CSS selectors: a Catalyst predicate on a node, or a test of parsed elements; to XPath where a path goes on from one."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"(?:[\w-]|\\.|[^\x00-\x7f])+"
_PART = re.compile(
    rf"(?P<tag>\*|(?:[A-Za-z_]|\\.|[^\x00-\x7f])(?:[\w-]|\\.|[^\x00-\x7f])*)|\.(?P<cls>{_NAME})|#(?P<id>{_NAME})"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]"
    r"|:(?P<pseudo>[a-z-]+)(?P<open>\()?"
)
# pseudo-classes that are settled when an element opens, and those that need what follows it
EARLY = ("first-child", "nth-child", "first-of-type", "nth-of-type", "not", "is", "where", "root")
LATE = ("last-child", "nth-last-child", "only-child", "last-of-type", "nth-last-of-type", "only-of-type", "empty", "contains")


def css_column(css: str) -> str:
    """Name of the column with the nodes of a selector that is evaluated while parsing."""
    return f"_css_{hashlib.md5(css.encode()).hexdigest()[:16]}"


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _quote(s: str) -> str:
    if '"' not in s:
        return f'"{s}"'
    if "'" not in s:
        return f"'{s}'"
    return "concat(" + ", '\"', ".join(f'"{part}"' for part in s.split('"')) + ")"


@dataclass(frozen=True)
class Compound:
    """One step of a selector: element name plus conditions."""

    tag: str = "*"
    attrs: tuple[tuple[str, str, str], ...] = ()
    pseudos: tuple[tuple[str, str], ...] = ()

    @property
    def simple(self) -> bool:
        return not self.pseudos

    @property
    def late(self) -> bool:
        """Whether later siblings or the content decide."""
        inner = (path for name, arg in self.pseudos if name in ("not", "is", "where") for path in arg)
        return any(name in LATE for name, _ in self.pseudos) or any(c.late for path in inner for _, c in path)

    def xpath(self, previous: bool = False) -> str:
        tests = [_attr_xpath(*a) for a in self.attrs]
        for name, arg in self.pseudos:
            if name == "first-child":
                tests.append("count(preceding-sibling::*) = 0")
            elif name == "last-child":
                tests.append("count(following-sibling::*) = 0")
            elif name == "nth-child" and arg[0] == 0:
                tests.append(f"count(preceding-sibling::*) = {arg[1] - 1}")
            elif name == "only-child":
                tests.append("count(../*) = 1")
            elif name == "empty":
                tests.append("not(*) and not(string-length())")
            elif name == "not" and all(len(path) == 1 for path in arg):
                tests += [f"not({path[0][1].condition()})" for path in arg]
            elif name == "contains":
                tests.append(f"contains(., {_quote(arg)})")
            else:
                raise ValueError(f"a path cannot go on from :{name}")
        if previous:
            return f"*[1]/self::{self.tag}" + "".join(f"[{t}]" for t in tests)
        return self.tag + "".join(f"[{t}]" for t in tests)

    def condition(self) -> str:
        return f"self::{self.xpath()}"

    def matches_node(self, node: Column) -> Column:
        """Predicate on a node struct; only for simple compounds."""
        tests = [node.tag.isNotNull() if self.tag == "*" else node.tag == self.tag]
        tests += [_attr_column(node.attrs[name], op, value) for name, op, value in self.attrs]
        return reduce(lambda a, b: a & b, tests)

    def matches_open(self, el) -> bool:
        if self.tag not in ("*", el.tag):
            return False
        if not all(_attr_test(el.attrs.get(name), op, value) for name, op, value in self.attrs):
            return False
        return all(_pseudo_test(el, name, arg) for name, arg in self.pseudos)


def _pseudo_test(el, name: str, arg) -> bool:
    if name in ("not", "is", "where"):
        return any(matches_path(el, path) for path in arg) != (name == "not")
    if name == "contains":
        return arg in el.text()
    if name == "empty":
        return el.empty
    if name == "root":
        return el.up is None
    of_type = name.endswith("of-type")
    before = el.type_place if of_type else el.place
    if name.startswith("only"):
        return before == 1 and (el.type_after if of_type else el.after) == 0
    if name.startswith(("last", "nth-last")):
        before = 1 + (el.type_after if of_type else el.after)
    step, first = arg if name.startswith("nth") else (0, 1)
    return before == first if step == 0 else (before - first) % abs(step) == 0 and (before - first) * step >= 0


Path = list[tuple[str, Compound]]


def _attr_xpath(name: str, op: str, value: str) -> str:
    q = _quote(value)
    return {
        "": f"@{name}",
        "=": f"@{name} = {q}",
        "~=": f"@{name} and contains(concat(' ', normalize-space(@{name}), ' '), {_quote(f' {value} ')})",
        "^=": f"starts-with(@{name}, {q})",
        "$=": f"substring(@{name}, string-length(@{name}) - {len(value) - 1}) = {q}",
        "*=": f"contains(@{name}, {q})",
        "|=": f"@{name} = {q} or starts-with(@{name}, {_quote(value + '-')})",
    }[op]


def _attr_column(attr: Column, op: str, value: str) -> Column:
    v = F.lit(value)
    test = {
        "": lambda: attr.isNotNull(),
        "=": lambda: attr == v,
        "~=": lambda: F.array_contains(F.split(attr, r"\s+"), value),
        "^=": lambda: F.startswith(attr, v),
        "$=": lambda: F.endswith(attr, v),
        "*=": lambda: F.contains(attr, v),
        "|=": lambda: (attr == v) | F.startswith(attr, F.lit(value + "-")),
    }[op]()
    return F.coalesce(test, F.lit(False))


def _attr_test(attr: str | None, op: str, value: str) -> bool:
    if attr is None:
        return False
    return {
        "": lambda: True,
        "=": lambda: attr == value,
        "~=": lambda: value in attr.split(),
        "^=": lambda: attr.startswith(value),
        "$=": lambda: attr.endswith(value),
        "*=": lambda: value in attr,
        "|=": lambda: attr == value or attr.startswith(value + "-"),
    }[op]()


def _closing(css: str, at: int) -> int:
    """Place of the parenthesis that closes the one before ``at``."""
    depth, quote = 1, ""
    while at < len(css):
        c = css[at]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "\\":
            at += 1
        else:
            depth += {"(": 1, ")": -1}.get(c, 0)
            if not depth:
                return at
        at += 1
    raise ValueError(f"unsupported selector: {css!r}")


def _argument(name: str, arg: str):
    if name in ("not", "is", "where"):
        return tuple(tuple(path) for path in parse_css(arg))
    if name.startswith("nth"):
        text = {"odd": "2n+1", "even": "2n"}.get(arg.strip().lower(), arg.replace(" ", "").lower())
        m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
        if not m or not text:
            raise ValueError(f"unsupported selector: :{name}({arg})")
        step = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
        return step, int(m[2] or 0)
    return arg.strip().strip("\"'")


def parse_compound(css: str) -> Compound:
    tag, attrs, pseudos, at = "*", [], [], 0
    while at < len(css):
        part = _PART.match(css, at)
        if not part:
            break
        at = part.end()
        if part["tag"]:
            tag = _plain(part["tag"]).lower()
        elif part["cls"]:
            attrs.append(("class", "~=", _plain(part["cls"])))
        elif part["id"]:
            attrs.append(("id", "=", _plain(part["id"])))
        elif part["attr"]:
            values = (part["dq"], part["sq"], part["bare"], "")
            attrs.append((part["attr"].lower(), part["op"] or "", next(v for v in values if v is not None)))
        else:
            name, arg = part["pseudo"], ""
            if part["open"]:
                end = _closing(css, at)
                arg, at = css[at:end], end + 1
            if name not in EARLY + LATE:
                raise ValueError(f"unsupported pseudo-class :{name}")
            pseudos.append((name, _argument(name, arg)))
    if at != len(css) or not css:
        raise ValueError(f"unsupported selector: {css!r}")
    return Compound(tag, tuple(attrs), tuple(pseudos))


def _tokens(css: str) -> list[str]:
    """Compounds, combinators and commas; what stands in brackets, parentheses or quotes or is escaped stays whole."""
    out, at, start = [], 0, 0

    def close() -> None:
        if css[start:at]:
            out.append(css[start:at])

    while at < len(css):
        c = css[at]
        if c == "\\":
            at += 2
        elif c == "(":
            at = _closing(css, at + 1) + 1
        elif c == "[":
            end = re.compile(r"\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\]").match(css, at)
            if not end:
                raise ValueError(f"unsupported selector: {css!r}")
            at = end.end()
        elif c in ">+~," or c.isspace():
            close()
            if not c.isspace():
                out.append(c)
            at += 1
            start = at
        else:
            at += 1
    close()
    return out


def parse_css(css: str) -> list[Path]:
    """Alternatives of a selector; each is a list of (combinator, compound) from left to right."""
    paths: list[Path] = [[]]
    combinator = " "
    for token in _tokens(css):
        if token == ",":
            paths.append([])
            combinator = " "
        elif token in ">+~":
            combinator = token
        else:
            paths[-1].append((combinator, parse_compound(token)))
            combinator = " "
    if not all(paths) or combinator != " ":
        raise ValueError(f"unsupported selector: {css!r}")
    return paths


def css_to_xpath(css: str) -> str:
    """Union of paths, each relative to its context node."""
    out = []
    for path in parse_css(css):
        xpath = "descendant-or-self::" + path[0][1].xpath()
        for combinator, compound in path[1:]:
            if combinator == " ":
                xpath += "/descendant::" + compound.xpath()
            elif combinator == ">":
                xpath += "/" + compound.xpath()
            elif combinator == "+":
                xpath += "/following-sibling::" + compound.xpath(previous=True)
            else:
                xpath += "/following-sibling::" + compound.xpath()
        out.append(xpath)
    return " | ".join(out)


def simple_compounds(css: str) -> list[Compound] | None:
    """The compounds of a selector without combinators and pseudo-classes, else None."""
    paths = parse_css(css)
    if all(len(path) == 1 and path[0][1].simple for path in paths):
        return [path[0][1] for path in paths]
    return None


def matches_path(el, path: Sequence[tuple[str, Compound]]) -> bool:
    """Whether an open element is selected, looking at the elements around and before it."""
    combinator, compound = path[-1]
    if not compound.matches_open(el):
        return False
    if len(path) == 1:
        return True
    rest = path[:-1]
    step = "left" if combinator in "+~" else "up"
    other = getattr(el, step)
    if combinator in ">+":
        return other is not None and matches_path(other, rest)
    while other is not None:
        if matches_path(other, rest):
            return True
        other = getattr(other, step)
    return False
