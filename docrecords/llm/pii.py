"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select them.

Base spans are found by fixed patterns and checks and always stay. Looser generators propose more spans, also overlapping
ones. Every proposal has a few small whole-number features of its format and its surroundings. The trees learn from all
proposals of the corpus, with the base checks as labels; as features are few and small, the corpus is counted into one row
for each combination (``CUBE_ROWS`` at most, whatever the input) and the trees are fitted to those counts. Proposals outside
base spans that score at least the threshold of their kind are added. Everything on the data is DataFrame functions.

Defined results: null text counts as empty and has no spans. Rows are judged each on its own. Where no proposal occurs
nothing is learned and nothing added. Extra columns do not matter; working columns are named ``_p_*``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.llm.common import table

KINDS = ("email", "ip", "card", "phone")
EMPTY = "array<struct<s:int,e:int,t:string>>"

# The base patterns, in forms that do not try the inside of a run again after its start has failed.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Proposals: anything that might be one of the kind.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:@|[\[(]at[\])])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]){8,}+",
    "phone": r"[+(]?[0-9]{1,4}+\)?[\x20.-]?\(?[0-9]{2,4}+\)?[\x20.-][0-9]{3,4}+(?:[\x20.-][0-9]{2,4}+)*+",
}
MAIL_HINT = r"@|[\[(]at[\])]"


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]++", "")


def luhn(digits: Column) -> Column:
    """The check sum of payment card numbers."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))

    def part(d: Column, i: Column) -> Column:
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, double).otherwise(d)

    return F.aggregate(F.transform(values, part), F.lit(0), lambda a, d: a + d) % 10 == 0


def small_parts(x: Column) -> Column:
    """All dotted numbers are at most 255."""
    return F.forall(
        F.split(x, r"\."),
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255),
    )


def passes(kind: str, x: Column) -> Column:
    n = F.length(digits_of(x))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return small_parts(x)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits_of(x))).otherwise(F.lit(False))
    return n.between(9, 15)


def check_of(kind: str) -> Callable[[Column], Column]:
    return lambda x: passes(kind, x["t"])


def found(text: Column, hits: Column, gaps: Column) -> Column:
    """Matches with their places in code points: ``gaps`` are the lengths of what lies before, between and after them."""

    def total(lengths: Column, n: Column) -> Column:
        return F.aggregate(F.slice(lengths, 1, n), F.lit(0), lambda a, x: a + x)

    lengths = F.transform(hits, F.length)

    def place(hit: Column, i: Column) -> Column:
        start = total(gaps, i + 1) + total(lengths, i)
        return F.struct(start.alias("s"), (start + F.length(hit)).alias("e"), hit.alias("t"))

    return F.transform(hits, place)


def with_matches(docs: DataFrame, patterns: dict[str, str], prefix: str) -> DataFrame:
    """Adds one array of (s, e, t) per kind. Texts without an at sign or a digit are not searched."""
    text = F.col("_p_text")
    mail, digit = text.rlike(MAIL_HINT), text.rlike("[0-9]")
    hits, gaps, out = {}, {}, {}
    for kind, pattern in patterns.items():
        hint = mail if kind == "email" else digit
        none = F.array().cast("array<string>")
        hits[f"_p_h_{kind}"] = F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    docs = docs.withColumns(hits)
    for kind, pattern in patterns.items():
        any_hit = F.size(f"_p_h_{kind}") > 0
        gaps[f"_p_g_{kind}"] = F.when(any_hit, F.transform(F.split(text, pattern, -1), F.length))
    docs = docs.withColumns(gaps)
    for kind in patterns:
        at = F.when(F.size(f"_p_h_{kind}") > 0, found(text, F.col(f"_p_h_{kind}"), F.col(f"_p_g_{kind}")))
        out[f"{prefix}{kind}"] = F.coalesce(at, F.array().cast(EMPTY))
    return docs.withColumns(out).drop(*hits, *gaps)


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_p_text`` and the base spans ``_p_b_<kind>``."""
    out = docs.withColumn("_p_text", F.coalesce(F.col(text), F.lit("")))
    out = with_matches(out, BASE, "_p_r_")
    kept = {f"_p_b_{k}": F.filter(f"_p_r_{k}", check_of(k)) for k in KINDS}
    return out.withColumns(kept).drop(*[f"_p_r_{k}" for k in KINDS])


# ------------------------------------------------------------------------------------------------- features

#: name of each feature and the number of values it has
FEATURES = {"digits": 21, "marks": 16, "lead": 3, "luhn": 2, "small": 2, "before": 4, "after": 4, "word": 2}
CUBE_ROWS = len(KINDS) * math.prod(FEATURES.values()) * 4
CONTEXT = 24
CONTEXT_WORDS = r"(?i)call|tel|phone|fax|mail|contact|card|visa|account|host|server|address|\bip\b"


def char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(3)


def features(text: Column, x: Column) -> dict[str, Column]:
    """Format and surroundings of a proposal. The text itself is not among them."""
    t, digits = x["t"], digits_of(x["t"])
    n = F.length(digits)
    marks = sum(F.when(F.contains(t, F.lit(m)), F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(" -.("))
    before = F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
    return {
        "digits": F.least(n, F.lit(20)),
        "marks": marks,
        "lead": F.when(t.startswith("+"), 1).when(t.startswith("("), 2).otherwise(0),
        "luhn": F.when(n.between(13, 19), luhn(digits).cast("int")).otherwise(0),
        "small": F.when(F.contains(t, F.lit(".")) & t.rlike(r"^[0-9.]+$"), small_parts(t).cast("int")).otherwise(0),
        "before": char_class(F.substring(before, -1, 1)),
        "after": char_class(F.substring(text, x["e"] + 1, F.lit(1))),
        "word": before.rlike(CONTEXT_WORDS).cast("int"),
    }


def proposal(text: Column, kind: int, y: int) -> Callable[[Column], Column]:
    def full(x: Column) -> Column:
        values = [v.cast("int").alias(n) for n, v in features(text, x).items()]
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(y).alias("y"), *values)

    return full


def not_among(spans: str) -> Callable[[Column], Column]:
    return lambda x: ~F.exists(spans, lambda y: (y["s"] == x["s"]) & (y["e"] == x["e"]))


def numbered(kind: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def with_proposals(docs: DataFrame) -> DataFrame:
    """Adds ``_p_c``: proposals as (kind, s, e, y, features); y tells whether it is a base span of its kind."""
    text = F.col("_p_text")
    out = with_matches(docs, LOOSE, "_p_l_")
    parts = []
    for k, kind in enumerate(KINDS):
        parts.append(F.transform(f"_p_b_{kind}", proposal(text, k, 1)))
        parts.append(F.transform(F.filter(f"_p_l_{kind}", not_among(f"_p_b_{kind}")), proposal(text, k, 0)))
    out = out.withColumn("_p_c", F.concat(*parts))
    return out.drop(*[f"_p_l_{k}" for k in KINDS])


# ------------------------------------------------------------------------------------------------- trees


@dataclass(frozen=True)
class Boosted:
    """Trees of depth two over the features, and the least log-odds that select a span, by kind.

    A tree is ``((feature, limit), (left split, low, high), (right split, low, high))``; values up to the limit go left.
    """

    start: float = 0.0
    trees: tuple = ()
    limits: tuple = (math.inf,) * len(KINDS)
    names: tuple = ("kind", *FEATURES)

    def score(self, x: Column) -> Column:
        total = F.lit(self.start)
        for (f, at), *sides in self.trees:
            low, high = (F.when(x[self.names[g]] <= to, F.lit(a)).otherwise(F.lit(b)) for (g, to), a, b in sides)
            total = total + F.when(x[self.names[f]] <= at, low).otherwise(high)
        return total

    def limit(self, x: Column) -> Column:
        chosen = F.lit(math.inf)
        for k, limit in enumerate(self.limits):
            chosen = F.when(x["kind"] == k, F.lit(float(limit))).otherwise(chosen)
        return chosen


@dataclass(frozen=True)
class Training:
    rounds: int = 24
    rate: float = 0.4
    ridge: float = 1.0
    precision: float = 0.99


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[tuple[int, int], float, float]:
    """The split with the largest gain, and Newton steps of both sides; ties go to the first feature and value."""
    best = (-math.inf, (0, int(x[:, 0].max(initial=0))), 0.0, 0.0)
    for f in range(x.shape[1]):
        width = int(x[:, f].max(initial=0)) + 1
        gs, hs = (np.cumsum(np.bincount(x[:, f], v, width)) for v in (g, h))
        gain = gs**2 / (hs + ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + ridge)
        at = int(np.argmax(np.round(gain, 9)))
        if gain[at] > best[0] + 1e-9:
            best = (gain[at], (f, at), -gs[at] / (hs[at] + ridge), -(gs[-1] - gs[at]) / (hs[-1] - hs[at] + ridge))
    return best[1:]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray, training: Training) -> Boosted:
    """Trees from the rows that are not held out; thresholds from those that are.

    A kind's threshold is the lowest score such that of the held-out weight at or above it a share of ``precision`` is
    labelled 1. Kinds without such a score select nothing.
    """
    w = np.where(held, 0.0, weight)
    if w[y == 1].sum() == 0:
        return Boosted()
    rate = (w[y == 1].sum() + 1) / (w.sum() + 2)
    start = math.log(rate / (1 - rate))
    score, trees = np.full(len(y), start), []
    for _ in range(training.rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)
        (f, at), _, _ = best_split(x, g, h, training.ridge)
        left = x[:, f] <= at
        sides = []
        for side in (left, ~left):
            (f2, at2), low, high = best_split(x[side], g[side], h[side], training.ridge)
            low, high = (round(training.rate * v, 6) for v in (low, high))
            sides.append(((f2, at2), low, high))
            score[side] += np.where(x[side][:, f2] <= at2, low, high)
        trees.append(((f, at), *sides))
    limits = []
    for k in range(len(KINDS)):
        own = held & (x[:, 0] == k)
        values = np.unique(score[own])[::-1]
        good = [v for v in values if weight[own & (score >= v - 1e-9) & (y == 1)].sum() >= training.precision * weight[own & (score >= v - 1e-9)].sum()]
        limits.append(round(min(good) - 1e-6, 6) if good else math.inf)
    return Boosted(start, tuple(trees), tuple(limits))


def learn(proposals: DataFrame, doc_id: str = "doc_id", training: Training = Training()) -> Boosted:
    """Count all proposals by features, label and fold, and fit the trees to the counts."""
    held = F.coalesce(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(5)) == 0, F.lit(False))
    # an inner explode would filter by the size of its input, below the projections and with a copy of their expressions
    each = proposals.select(held.alias("held"), F.explode_outer("_p_c").alias("c")).filter("c is not null")
    names = ["kind", *FEATURES]
    cube = each.groupBy("held", "c.y", *[f"c.{n}" for n in names]).count()
    rows = cube.collect()  # at most CUBE_ROWS
    if not rows:
        return Boosted()
    rows.sort(key=lambda r: [r[n] for n in ("held", "y", *names)])
    x = np.array([[r[n] for n in names] for r in rows])
    y, weight, held_out = (np.array([r[n] for r in rows]) for n in ("y", "count", "held"))
    return fit(x, y.astype(float), weight.astype(float), held_out.astype(bool), training)


def with_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", training: Training = Training()) -> DataFrame:
    """Adds ``_p_base`` and ``_p_spans``, arrays of (kind, s, e) by kind and start."""
    proposals = with_proposals(with_base(docs, text))
    model = learn(proposals, doc_id, training)
    base = F.concat(*[F.transform(f"_p_b_{k}", numbered(i)) for i, k in enumerate(KINDS)])
    out = proposals.withColumn("_p_base", base)

    def added(x: Column) -> Column:
        apart = ~F.exists("_p_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        return (x["y"] == 0) & (model.score(x) >= model.limit(x)) & apart

    more = F.transform(F.filter("_p_c", added), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return out.withColumn("_p_spans", F.sort_array(F.concat("_p_base", more))).drop("_p_c")


def listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(one, ",")


def redacted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, of the first one's kind.

    ``n_chars``: a column with the length of the text, which is set anew where the text changes.
    """
    out = with_spans(docs, text, doc_id)
    by_place = F.sort_array(F.transform("_p_spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    out = out.withColumn("_p_order", by_place)
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("to"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("_p_text"), acc["to"] + 1, x["s"] - acc["to"])
        inside = x["s"] < acc["to"]
        return F.struct(
            F.when(inside, acc["done"]).otherwise(F.concat(acc["done"], gap, F.get(labels, x["kind"]))).alias("done"),
            F.greatest(acc["to"], -x["e"]).alias("to"),
        )

    whole = F.aggregate("_p_order", start, step, lambda acc: F.concat(acc["done"], F.substring(F.col("_p_text"), acc["to"] + 1, F.length("_p_text"))))
    clean = F.when(F.size("_p_order") > 0, whole).otherwise(F.col(text))
    out = out.withColumn(text, clean)
    if n_chars:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(n_chars, F.when(F.size("_p_order") > 0, F.length(text).cast(kind)).otherwise(F.col(n_chars)))
    return out.select(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"_p_b_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(listed("_p_base"), 256).alias("base_sha256"), listed("_p_spans").alias("spans"))
