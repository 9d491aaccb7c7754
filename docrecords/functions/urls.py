"""URL functions on Columns, and the regex dialect shared by all rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrecords.functions.text import let

# Characters that stay readable in the path of a canonical URL.
PATH_SAFE = ":/@!$&'()*+,;=~[]"
# File types that are not followed as pages.
IGNORED_EXTENSIONS = (
    "7z 7zip bz2 rar tar tar.gz xz zip "
    "mng pct bmp gif jpg jpeg png pst psp tif tiff ai drw dxf eps ps svg cdr ico webp "
    "mp3 wma ogg wav ra aac mid au aiff 3gp asf asx avi mov mp4 mpg qt rm swf wmv m4a m4v flv webm "
    "xls xlsm xlsx xltm xltx potm potx ppt pptm pptx pps doc docb docm docx dotm dotx odt ods odg odp "
    "css pdf exe bin rss dmg iso apk jar sh rb js hta bat cpl msi msp py"
).split()


def java_regex(pattern: str) -> str:
    """Rewrite named groups of a Python pattern for the JVM (group names there are letters and digits only)."""
    names: dict[str, str] = {}

    def opening(match: re.Match) -> str:
        names[match[1]] = f"g{len(names)}"
        return f"(?<{names[match[1]]}>"

    pattern = re.sub(r"\(\?P<([^>]+)>", opening, pattern)
    pattern = re.sub(r"\(\?P=([^)]+)\)", lambda m: rf"\k<{names.get(m[1], m[1])}>", pattern)
    return pattern.replace(r"\Z", r"\z")


def found(col: Column, pattern: str) -> Column:
    """The pattern occurs anywhere in the text."""
    return col.rlike(java_regex(pattern))


def starts(col: Column, pattern: str) -> Column:
    """The pattern matches at the start of the text."""
    return col.rlike(rf"\A(?:{java_regex(pattern)})")


def any_found(col: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [found(col, p) for p in patterns], F.lit(False))


def first_rule(col: Column, patterns: Sequence[str], test=found) -> Column:
    """0-based index of the first pattern that applies, null for none."""
    if not patterns:
        return F.lit(None).cast("int")
    case = F.when(test(col, patterns[0]), F.lit(0))
    for ix, pattern in enumerate(patterns[1:], 1):
        case = case.when(test(col, pattern), F.lit(ix))
    return case


def variable_names(col: Column) -> Column:
    """Names of the variables written in a URL pattern, in order."""
    return F.regexp_extract_all(col, F.lit(r"\(\?P<(.+?)>.+?\)"), F.lit(1))


def netloc(col: Column) -> Column:
    """Domain part with port and user info. A regex instead of a URL parser, since patterns are allowed."""
    return F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def hostname(col: Column) -> Column:
    return F.lower(F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def any_scheme(col: Column) -> Column:
    """Pattern for the same URL under http and https; other text is left as it is."""
    rest = F.regexp_extract(col, r"^https?(.*)", 1)
    return F.when(col.rlike(r"^https?"), F.concat(F.lit("^https?"), rest, F.lit("(.*)$"))).otherwise(col)


def any_scheme_pattern(url: str) -> str:
    """The same as :func:`any_scheme` for one configured URL."""
    hit = re.match(r"https?(.*)", url)
    return f"^https?{hit[1]}(.*)$" if hit else url


def other_scheme(col: Column) -> Column:
    """The URL under the other scheme; anything but http(s) is an error."""
    return (
        F.when(col.rlike(r"^https."), F.concat(F.lit("http"), F.substr(col, F.lit(6))))
        .when(col.rlike(r"^http[^s]"), F.concat(F.lit("https"), F.substr(col, F.lit(5))))
        .when(col.isNull(), F.lit(None).cast("string"))
        .otherwise(F.raise_error(F.concat(F.lit("no http(s) scheme: "), col)).cast("string"))
    )


def drop_params(col: Column) -> Column:
    """Scheme, domain and path only."""
    return F.regexp_extract(col, r"^([^?#;]*)", 1)


def drop_bare_fragment(url: Column, request_url: Column) -> Column:
    """A response URL that only adds ``#`` to the request is the request URL."""
    return F.when(url == F.concat(request_url, F.lit("#")), request_url).otherwise(url)


def _path(col: Column) -> Column:
    plain = col.rlike(r"^[A-Za-z0-9_.\-:/@!$&'()*+,;=~\[\]]*$")
    # escaped slashes and question marks stay escaped, a plus sign is not a space in a path
    shielded = F.regexp_replace(F.regexp_replace(col, "(?i)%2f", "%252F"), "(?i)%3f", "%253F")
    decoded = F.try_url_decode(F.replace(shielded, F.lit("+"), F.lit("%2B")))
    encoded = F.replace(F.url_encode(decoded), F.lit("+"), F.lit("%20"))
    for char in PATH_SAFE:
        encoded = F.replace(encoded, F.lit(f"%{ord(char):02X}"), F.lit(char))
    encoded = F.replace(F.replace(encoded, F.lit("%252F"), F.lit("%2F")), F.lit("%253F"), F.lit("%3F"))
    return F.when(plain, col).otherwise(F.coalesce(encoded, col))


def _query_part(col: Column) -> Column:
    plain = col.rlike(r"^[A-Za-z0-9_.~+-]*$")
    encoded = F.replace(F.url_encode(F.try_url_decode(col)), F.lit("*"), F.lit("%2A"))
    return F.when(plain, col).otherwise(F.coalesce(F.replace(encoded, F.lit("%7E"), F.lit("~")), col))


def canonical(col: Column) -> Column:
    """Lower-case domain, normalised escapes, sorted query arguments, no fragment."""
    # bound once, here and below: the parts refer to it many times and such functions get nested
    return let(col, _canonical)


def _canonical(col: Column) -> Column:
    head = F.regexp_extract(col, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    domain = F.regexp_replace(netloc(col), ":$", "")
    path = F.regexp_extract(col, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(col, r"^[^?#]*\?([^#]*)", 1)
    return F.concat(
        F.lower(head),
        F.lower(domain),
        let(path, lambda p: F.when(p == "", F.lit("/")).otherwise(_path(p))),
        let(query, lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), _arguments(q)))),
    )


def _arguments(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _query_part(F.substring_index(p, "=", 1)).alias("k"),
            _query_part(F.regexp_extract(p, "^[^=]*=(.*)", 1)).alias("v"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p.k, F.lit("="), p.v)), "&")


def fingerprint(col: Column, *, with_scheme: bool = False, use_anchors: bool = False) -> Column:
    """Identity of a GET request for a URL; by default the same for http and https."""
    url = col if use_anchors else canonical(col)
    if not with_scheme:
        url = F.regexp_replace(url, r"(https?)(.*)", "$2")
    return F.sha1(F.concat(F.lit("GET"), url))


def follow_allowed(col: Column, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> Column:
    """Some allow pattern is found (none given: all URLs) and no deny pattern is."""
    keep = any_found(col, allow) if allow else F.lit(True)
    return keep & ~any_found(col, deny) if deny else keep


def is_page_link(col: Column) -> Column:
    """A link that can lead to a page: a fetchable scheme and no file type that is never a page."""
    path = F.lower(F.regexp_extract(col, r"^[^?#;]*", 0))
    types = "|".join(re.escape(e) for e in IGNORED_EXTENSIONS)
    return col.rlike(r"^(https?|file|ftp)://") & ~path.rlike(rf"://[^/]*/.*\.({types})$")


def in_domains(col: Column, domains: Sequence[str]) -> Column:
    """The host is one of the domains or below one of them."""
    names = F.array(*[F.lit(d.lower()) for d in domains]).cast("array<string>")
    return let(
        hostname(col), lambda host: F.exists(names, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    )


def redirect_ok(
    url: Column, request_url: Column, allow: Sequence[str], deny: Sequence[str] = (), strict: bool = True
) -> Column:
    """Both ends of a redirect must be allowed, or either one when not strict."""
    here = is_page_link(url) & follow_allowed(url, allow, deny)
    asked = is_page_link(request_url) & follow_allowed(request_url, allow, deny)
    return (here & asked) if strict else (here | asked)


def resolve_link(link: Column, base: Column) -> Column:
    """Absolute form of a link found on the page ``base``; dot segments are folded."""
    return let(F.struct(F.btrim(link).alias("link"), base.alias("base")), lambda v: _resolve(v.link, v.base))


def _resolve(link: Column, base: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    with_query = F.regexp_extract(base, r"^([^#]*)", 1)
    folder = F.when(base.rlike(r"^[^:]+://[^/?#]*([?#].*)?$"), F.concat(root, F.lit("/"))).otherwise(
        F.regexp_extract(base, r"^([^?#]*/)", 1)
    )
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(link == "", with_query)
        .when(F.startswith(link, F.lit("#")), F.concat(with_query, link))
        .when(F.startswith(link, F.lit("?")), F.concat(page, link))
        .otherwise(F.concat(folder, link))
    )
    has_dots = link.rlike(r"(^|/)\.\.?(/|$|[?#])")
    return let(full, lambda url: F.when(has_dots, _fold_dots(url)).otherwise(url))


def _fold_dots(col: Column) -> Column:
    head = F.regexp_extract(col, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(col, r"^[^?#]*(.*)$", 1)
    steps = F.split(F.regexp_replace(path, r"/\.\.?$", "$0/"), "/")
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.least(F.size(acc), F.lit(1)))))
        .otherwise(F.array_append(acc, s)),
    )
    return F.when(col.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(head, F.array_join(kept, "/"), tail)).otherwise(col)
