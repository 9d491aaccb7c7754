"""What to extract: selectors, URL rules and switches. Parameters only, no data."""

from __future__ import annotations

import itertools
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

LEVELS = tuple(f"lvl{n}" for n in range(7))
CONTENT = 7
"""Level number of content rows; headings are 0 to 6."""


@dataclass(frozen=True)
class Selector:
    selector: str
    type: str = "css"
    is_global: bool = False
    default_value: str | None = None
    strip_chars: str | None = None
    attributes: Mapping[str, Selector] | None = None

    @staticmethod
    def of(value: str | Mapping | Selector) -> Selector:
        if isinstance(value, Selector):
            return value
        if isinstance(value, str):
            return Selector(value)
        kind = value.get("type", "css")
        if kind not in ("css", "xpath"):
            raise ValueError(f"{kind} is not a selector type, use xpath or css")
        inner = value.get("attributes")
        return Selector(
            value["selector"],
            kind,
            bool(value.get("global", False)),
            value.get("default_value"),
            value.get("strip_chars"),
            selector_map(inner) if inner is not None else None,
        )


def selector_map(raw: Mapping) -> dict[str, Selector]:
    """Named selectors; the key ``text`` is an older name of ``content``."""
    return {("content" if key == "text" else key): Selector.of(value) for key, value in raw.items()}


@dataclass(frozen=True)
class SelectorSet:
    key: str
    selectors: Mapping[str, Selector]

    @property
    def used_levels(self) -> list[str]:
        """lvl0 up to the first missing one, then content."""
        used = list(itertools.takewhile(lambda name: name in self.selectors, LEVELS))
        return used + (["content"] if "content" in self.selectors else [])

    @property
    def heading_count(self) -> int:
        return sum(name != "content" for name in self.used_levels)

    @property
    def page_wide(self) -> dict[str, Selector]:
        """Selectors read once per page: global levels and everything that is not a used level."""
        used = self.used_levels
        return {k: s for k, s in self.selectors.items() if k not in used or s.is_global}

    @property
    def extras(self) -> list[str]:
        """Names that become record attributes."""
        return [k for k in self.selectors if "lvl" not in k and k not in ("content", "text")]

    def strip_for(self, name: str, default: str) -> str:
        chars = self.selectors[name].strip_chars
        return default if chars is None else chars


@dataclass(frozen=True)
class StartUrl:
    url: str
    page_rank: int = 0
    tags: tuple[str, ...] = ()
    selectors_key: str = "default"
    extra_attributes: Mapping[str, Any] | None = None
    url_attributes: Mapping[str, str] = field(default_factory=dict)
    original_url: str | None = None


def start_urls_of(raw: list) -> tuple[StartUrl, ...]:
    """Fill in defaults and write out the URL variables: one rule per combination of values."""
    out = []
    for item in raw:
        item = {"url": item} if isinstance(item, str) else dict(item)
        url = item["url"]
        rule = StartUrl(
            url,
            int(item.get("page_rank", 0)),
            tuple(item.get("tags", ())),
            item.get("selectors_key", "default"),
            item.get("extra_attributes"),
        )
        names = list(dict.fromkeys(re.findall(r"\(\?P<(.+?)>.+?\)", url)))
        if not names:
            out.append(rule)
            continue
        values = item.get("variables", {})
        for name in names:
            if not isinstance(values.get(name), (list, tuple)):
                raise ValueError(f"variable {name} of {url} needs a list of values")
        for combination in itertools.product(*(values[name] for name in names)):
            written = url
            for name, value in zip(names, combination):
                written = written.replace(f"(?P<{name}>.*?)", value)
            out.append(
                replace(rule, url=written, original_url=url, url_attributes=dict(zip(names, combination)))
            )
    return tuple(out)


@dataclass(frozen=True)
class Spec:
    """All parameters of a run. Use :meth:`of` to build one from plain keyword arguments or a mapping."""

    index_uid: str
    start_urls: tuple[StartUrl, ...] = ()
    stop_urls: tuple[str, ...] = ()
    only_urls: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    sitemap_urls: tuple[str, ...] = ()
    sitemap_urls_regexs: tuple[str, ...] = ()
    sitemap_alternate_links: bool = False
    force_sitemap_urls_crawling: bool = False
    scrape_start_urls: bool = True
    strict_redirect: bool = True
    remove_get_params: bool = False
    use_anchors: bool = False
    js_render: bool = False
    selectors: Mapping[str, SelectorSet] = field(default_factory=dict)
    selectors_exclude: tuple[str, ...] = ()
    stop_content: tuple[str, ...] = ()
    keep_tags: tuple[str, ...] = ()
    strip_chars: str = ".,;:§¶"
    min_indexed_level: Mapping[str, int] = field(default_factory=lambda: {"default": 0})
    only_content_level: bool = False
    # most records of a run; 0: no cap
    nb_hits_max: int = 0
    meta_prefix: str = "docrecords:"

    @staticmethod
    def of(config: Mapping | None = None, **kwargs) -> Spec:
        raw = {**(config or {}), **kwargs}
        _check(raw)
        known = {f.name for f in fields(Spec)}
        args: dict[str, Any] = {k: v for k, v in raw.items() if k in known and v is not None}
        for name in ("stop_urls", "only_urls", "sitemap_urls", "sitemap_urls_regexs", "keep_tags"):
            if name in args:
                args[name] = tuple(args[name])
        for name in ("stop_content", "selectors_exclude", "allowed_domains"):
            if name in args:
                args[name] = (args[name],) if isinstance(args[name], str) else tuple(args[name])
        args["start_urls"] = start_urls_of(raw.get("start_urls") or [])
        if raw.get("scrap_start_urls") is False:
            args["scrape_start_urls"] = False
        if not args.get("allowed_domains"):
            args["allowed_domains"] = domains_of([s.url for s in args["start_urls"]] + list(args.get("stop_urls", ())))
        sets = raw.get("selectors") or {}
        if "lvl0" in sets:
            sets = {"default": sets}
        args["selectors"] = {key: SelectorSet(key, selector_map(inner)) for key, inner in sets.items()}
        level = raw.get("min_indexed_level", 0)
        args["min_indexed_level"] = {"default": level} if isinstance(level, int) else dict(level)
        return Spec(**args)

    def facets(self) -> list[str]:
        """Names of all URL variables."""
        return sorted({name for rule in self.start_urls for name in rule.url_attributes})

    def set_for(self, key: str) -> SelectorSet:
        if key in self.selectors:
            return self.selectors[key]
        return self.selectors["default"]

    def min_level_for(self, key: str) -> int:
        if key in self.min_indexed_level:
            return self.min_indexed_level[key]
        return self.min_indexed_level["default"]


def domains_of(urls: list[str]) -> tuple[str, ...]:
    """Distinct domains in first-seen order."""
    hits = (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url) for url in urls)
    return tuple(dict.fromkeys(hit[1] if hit else "" for hit in hits))


def _check(raw: Mapping) -> None:
    def need(ok: bool, message: str) -> None:
        if not ok:
            raise ValueError(message)

    need(bool(raw.get("index_uid")), "index_uid: a name for the index is needed")
    need(bool(raw.get("start_urls") or raw.get("sitemap_urls")), "a run needs start_urls or sitemap_urls")
    for name in ("start_urls", "stop_urls"):
        need(not raw.get(name) or isinstance(raw[name], (list, tuple)), f"{name} should be a list")
    for name in ("js_render", "use_anchors", "sitemap_alternate_links"):
        need(not raw.get(name) or isinstance(raw[name], bool), f"{name} should be a boolean")
    for name in ("js_wait", "nb_hits_max"):
        need(not raw.get(name) or isinstance(raw[name], int), f"{name} should be an integer")
    need(not raw.get("custom_settings") or isinstance(raw["custom_settings"], Mapping), "custom_settings should be a dict")
    for name in ("sitemap_urls_regexs", "force_sitemap_urls_crawling"):
        need(not raw.get(name) or bool(raw.get("sitemap_urls")), f"{name} needs sitemap_urls")
    both_off = raw.get("scrape_start_urls") is False and raw.get("scrap_start_urls") is False
    need(not both_off, "use only scrape_start_urls")
