"""URL rules as a table: the first rule (smallest ``ord``) whose pattern applies to a URL, by an equi-join on literals.

A match of a pattern contains every literal run that the pattern requires, so it contains each piece of them. Rules with
the same pattern are one rule with the smallest ``ord``. A run is cut into pieces of the largest of ``SIZES`` characters
that fits: long pieces, such as most of a host, are shared by few URLs. Every rule is keyed by its rarest piece, counted
over all URLs; URLs are cut into their distinct pieces, of the sizes that the rules have, and joined with the rules by piece.
Only these candidates are tested with the pattern itself, and the smallest ``ord`` per URL and kind of test is kept. The
join is exact: a URL that a rule applies to always shares the rule's key. Pieces are counted and joined as 64-bit hashes;
equal hashes of other pieces only add candidates.

A rule whose pattern requires no literal run of three characters (``.*``, ``[a-z]+``, top-level alternatives) has no key;
it is tested against every URL. Such rules are expected to be few: they are broadcast, and at most ``UNKEYED_MAX`` of them
are allowed (an error says so beyond).

Defined results: a null URL or pattern matches nothing; rules that share an ``ord`` keep it (the smallest wins, ties by
pattern); rows of ``urls`` are kept as they are, also with equal ids. Columns ``_r_*`` are working columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecords.functions.urls import java_regex

GRAM = 3
#: characters of a piece; a run is cut by the largest that fits, the smallest is ``GRAM``
SIZES = (GRAM, 4, 5, 6, 8, 12, 24, 48)
UNKEYED_MAX = 1000

#: characters with a meaning in a pattern outside a character class
_META = set(".^$*+?()[]{}|\\")
#: escapes that stand for themselves
_PLAIN_ESCAPES = set(".^$*+?()[]{}|\\/-:#&=%@!,;'\"<> ")


def required_literals(pattern: str | None) -> list[str]:
    """Runs of characters that every match of ``pattern`` contains, in order; none where that cannot be told simply."""
    if not pattern:
        return []
    runs, run, depth, i = [], [], 0, 0

    def cut() -> None:
        if run and depth == 0:
            runs.append("".join(run))
        run.clear()

    # top-level alternatives require nothing in common that is simple to tell
    level, at = 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 2
            continue
        if c == "[":
            close = pattern.find("]", at + 2 if pattern[at + 1 : at + 2] in ("]", "^") else at + 1)
            at = len(pattern) if close < 0 else close + 1
            continue
        level += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and level == 0:
            return []
        at += 1
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            literal = pattern[i + 1] if pattern[i + 1] in _PLAIN_ESCAPES else None
            step = 2
        elif c == "[":
            close = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("]", "^") else i + 1)
            literal, step = None, (len(pattern) - i if close < 0 else close + 1 - i)
        elif c == "(":
            cut()
            depth += 1
            i += 1
            continue
        elif c == ")":
            depth = max(depth - 1, 0)
            cut()
            i += 1
            # a quantifier after a group belongs to the group
            continue
        elif c == "{":
            close = pattern.find("}", i)
            literal, step = None, (len(pattern) - i if close < 0 else close + 1 - i)
        elif c in _META:
            literal, step = None, 1
        else:
            literal, step = c, 1
        following = pattern[i + step : i + step + 1]
        if literal is None or depth > 0:
            cut()
        elif following in ("?", "*") or (following == "{" and pattern[i + step + 1 : i + step + 2] in ("0", ",")):
            cut()  # the character may be missing
        elif following in ("+", "{"):
            run.append(literal)
            cut()  # the character may repeat: the run cannot go on past it
        else:
            run.append(literal)
        i += step
    cut()
    return runs


def prepared_rules(rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Adds ``_r_java`` (the pattern for the JVM) and ``_r_runs`` (its required literal runs)."""

    @F.pandas_udf("struct<_r_java:string,_r_runs:array<string>>")
    def prepare(patterns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "_r_java": [None if p is None else java_regex(p) for p in patterns],
                "_r_runs": [required_literals(p) for p in patterns],
            }
        )

    # else a filter on its result would be moved below a grouping by pattern, and run it for every row there
    prepare = prepare.asNondeterministic()
    return rules.withColumn("_r_prep", prepare(F.col(pattern))).select("*", "_r_prep.*").drop("_r_prep")


def _cut(text, size: int, step: int = 1) -> F.Column:
    """Pieces of ``size`` characters that begin at every ``step``-th character; none for shorter strings."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1, F.lit(step)), lambda i: F.substring(text, i, size))
    return F.when(F.length(text) >= size, every).otherwise(F.array().cast("array<string>"))


def _pieces(text, sizes: Sequence[int]) -> F.Column:
    """Hashes of the distinct pieces of a string column, of all ``sizes``."""
    return F.array_distinct(F.transform(F.concat(*[_cut(text, size) for size in sizes]), lambda piece: F.xxhash64(piece)))


def _pieces_of_run(run) -> F.Column:
    """Pieces of the largest size that fits, a quarter of a size apart: enough to choose from, and few for long runs."""
    pieces = F.array().cast("array<string>")
    for size in SIZES:
        pieces = F.when(F.length(run) >= size, _cut(run, size, max(1, size // 4))).otherwise(pieces)
    return pieces


def _pieces_of_runs(runs: F.Column) -> F.Column:
    return F.array_distinct(F.flatten(F.transform(runs, _pieces_of_run)))


def first_rules(urls: DataFrame, rules: DataFrame, url: str = "url", pattern: str = "pattern", order: str = "ord") -> DataFrame:
    """``urls`` with ``found_ord`` (first rule found anywhere in the URL) and ``start_ord`` (first rule matching at its start)."""
    rows = urls.withColumn("_r_row", F.monotonically_increasing_id())
    texts = rows.select("_r_row", F.col(url).alias("_r_url"))
    # rules that share a pattern apply to the same URLs: the smallest ord stands for all of them
    shared = rules.select(F.col(order).alias("_r_ord"), F.col(pattern).alias("_r_pattern")).filter(F.col("_r_pattern").isNotNull())
    shared = shared.groupBy("_r_pattern").agg(F.min("_r_ord").alias("_r_ord"), F.count(F.lit(1)).alias("_r_rules"))
    prepared = prepared_rules(shared, "_r_pattern").withColumn("_r_pieces", _pieces_of_runs(F.col("_r_runs")))
    keyed = prepared.filter(F.size("_r_pieces") > 0)
    unkeyed = prepared.filter(F.size("_r_pieces") == 0).select("_r_ord", "_r_java")

    sizes_of = F.array_sort(F.array_distinct(F.transform("_r_pieces", lambda piece: F.length(piece))))
    # one row: the number of rules without a key, and the sizes in use (SIZES at most)
    facts = prepared.agg(
        F.sum(F.when(F.size("_r_pieces") == 0, F.col("_r_rules"))).alias("n_unkeyed"),
        F.array_distinct(F.flatten(F.collect_set(sizes_of))).alias("sizes"),
    ).first()
    n_unkeyed, sizes = facts["n_unkeyed"] or 0, sorted(facts["sizes"]) or [GRAM]
    if n_unkeyed > UNKEYED_MAX:
        raise ValueError(f"more than {UNKEYED_MAX} rules without a literal of {GRAM} characters")

    url_pieces = texts.select("_r_row", F.explode(_pieces(F.col("_r_url"), sizes)).alias("_r_piece"))
    counts = url_pieces.groupBy("_r_piece").agg(F.count(F.lit(1)).alias("_r_n"))
    rule_pieces = keyed.select("_r_ord", "_r_java", F.explode("_r_pieces").alias("_r_text"))
    rule_pieces = rule_pieces.select("_r_ord", "_r_java", F.xxhash64("_r_text").alias("_r_piece"))
    # every rule's rarest piece, counted over all URLs; pieces that no URL holds count 0 and leave the rule without candidates
    chosen = (
        rule_pieces.join(counts, "_r_piece", "left")
        .withColumn("_r_n", F.coalesce("_r_n", F.lit(0)))
        .groupBy("_r_ord", "_r_java")
        .agg(F.min_by("_r_piece", F.struct("_r_n", "_r_piece")).alias("_r_piece"))
    )
    candidates = url_pieces.join(chosen, "_r_piece").select("_r_row", "_r_ord", "_r_java")
    tested = candidates.join(texts, "_r_row").select("_r_row", "_r_ord", "_r_java", "_r_url")
    if n_unkeyed:
        # the few rules that name no literal are tested everywhere; a bounded, broadcast side
        tested = tested.unionByName(texts.crossJoin(F.broadcast(unkeyed)))
    found = F.regexp_like(F.col("_r_url"), F.col("_r_java"))
    starts = F.regexp_like(F.col("_r_url"), F.concat(F.lit(r"\A(?:"), F.col("_r_java"), F.lit(")")))
    firsts = tested.groupBy("_r_row").agg(
        F.min(F.when(found, F.col("_r_ord"))).alias("found_ord"), F.min(F.when(starts, F.col("_r_ord"))).alias("start_ord")
    )
    return rows.join(firsts, "_r_row", "left").drop("_r_row")
