"""URL rules held as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecords.functions.urls import netloc, variable_names


def normalise_rules(rules: DataFrame) -> DataFrame:
    """Fill in the defaults of a rule table; only ``ord`` and ``url`` are needed."""
    have = set(rules.columns)

    def or_default(name: str, default):
        return F.coalesce(F.col(name), default) if name in have else default

    return rules.withColumns(
        {
            "page_rank": or_default("page_rank", F.lit(0)).cast("int"),
            "tags": or_default("tags", F.array().cast("array<string>")),
            "selectors_key": or_default("selectors_key", F.lit("default")),
        }
    )


def expand_variables(rules: DataFrame) -> DataFrame:
    """One rule per combination of variable values, the first variable varying slowest.

    ``variables map<string, array<string>>`` holds the values. Adds ``url_attributes`` and ``original_url``; ``path``
    orders the results of one rule. Combinations grow inside the row, one variable after the other.
    """
    missing = F.raise_error(F.concat(F.lit("missing values for a variable of "), F.col("url"))).cast("array<string>")
    kind = "struct<url:string,attributes:map<string,string>,path:array<int>>"
    first = F.struct(F.col("url").alias("url"), F.create_map().alias("attributes"), F.array().alias("path")).cast(kind)

    def with_value(done: Column, name: Column):
        def written(value: Column, place: Column) -> Column:
            url = F.replace(done["url"], F.concat(F.lit("(?P<"), name, F.lit(">.*?)")), value)
            attributes = F.map_concat(done["attributes"], F.create_map(name, value))
            return F.struct(url.alias("url"), attributes.alias("attributes"), F.array_append(done["path"], place).alias("path")).cast(kind)

        return written

    def one_more(found: Column, name: Column) -> Column:
        values = F.coalesce(F.col("variables")[name], missing)
        return F.flatten(F.transform(found, lambda done: F.transform(values, with_value(done, name))))

    names = F.array_distinct(variable_names(F.col("url")))
    found = F.aggregate(names, F.array(first).cast(f"array<{kind}>"), lambda acc, name: one_more(acc, name).cast(f"array<{kind}>"))
    kept = [c for c in rules.columns if c != "url"]
    out = rules.select(*kept, F.col("url").alias("original_url"), F.explode(found).alias("_made"))
    return out.select(
        F.col("_made.url").alias("url"), *kept, "original_url", F.col("_made.attributes").alias("url_attributes"), F.col("_made.path").alias("path")
    )


def facet_names(rules: DataFrame) -> DataFrame:
    """Distinct URL variable names."""
    return rules.select(F.explode(F.map_keys("url_attributes")).alias("facet")).distinct()


def allowed_domains(urls: DataFrame) -> DataFrame:
    """Distinct domains of ``(ord, url)`` with the place of their first URL."""
    return urls.select("ord", netloc(F.col("url")).alias("domain")).groupBy("domain").agg(F.min("ord").alias("ord"))
