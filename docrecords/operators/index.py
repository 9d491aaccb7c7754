"""The index table: flat documents, batches, rebuild and partial update."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrecords.functions.text import flag_text, restore_apostrophes
from docrecords.operators.prefix import running
from docrecords.spec import LEVELS

BATCH = 50


def flatten(records: DataFrame) -> DataFrame:
    """Lift weight and hierarchy out of their structs."""
    inner = ("weight", "hierarchy", "hierarchy_radio")
    return records.select(
        *[c for c in records.columns if c not in inner],
        "weight.page_rank",
        "weight.level",
        "weight.position",
        *[F.col(f"hierarchy.{name}").alias(f"hierarchy_{name}") for name in LEVELS],
        *[F.col(f"hierarchy_radio.{name}").alias(f"hierarchy_radio_{name}") for name in LEVELS],
    )


def clean(docs: DataFrame) -> DataFrame:
    """Booleans become text (JSON ones in maps too), the apostrophe entity is written out; arrays stay."""
    out: dict[str, Column] = {}
    for name, kind in docs.dtypes:
        if kind == "boolean":
            out[name] = flag_text(F.col(name))
        elif kind == "string" and name != "objectID":
            out[name] = restore_apostrophes(F.col(name))
        elif kind == "map<string,string>":
            out[name] = F.transform_values(
                name,
                lambda _, v: F.when(v == "true", F.lit('"True"')).when(v == "false", F.lit('"False"')).otherwise(restore_apostrophes(v)),
            )
        elif kind == "map<string,map<string,string>>":
            inner = lambda _, m: F.transform_values(m, lambda _k, v: restore_apostrophes(v))
            out[name] = F.transform_values(name, inner)
    return docs.withColumns(out) if out else docs


def override(docs: DataFrame, names: Sequence[str] = ("anchor", "content", "type", "tags")) -> DataFrame:
    """Page attributes named like a column of the record replace it."""
    kinds = dict(docs.dtypes)
    out = {}
    for name in names:
        value = F.col("extras")[name]
        read = F.from_json(value, kinds[name]) if kinds[name].startswith("array") else F.get_json_object(value, "$")
        out[name] = F.when(F.map_contains_key("extras", name), read).otherwise(F.col(name))
    return docs.withColumns(out)


def promote(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Page attributes as text columns."""
    return docs.withColumns({name: F.get_json_object(F.col("extras")[name], "$") for name in names})


def index_docs(records: DataFrame, extras: Sequence[str] = ()) -> DataFrame:
    """Records as they are stored."""
    return clean(promote(override(flatten(records)), ["lang", *extras]))


def add_batches(
    docs: DataFrame, keys: Sequence[str], order: str, size: int = BATCH, large: bool = False
) -> DataFrame:
    """1-based number of the emission batch within the page."""
    docs = running(docs, keys, order, sums={"_sent": F.lit(1)}, large=large)
    return docs.withColumn("batch", (F.floor(F.col("_sent") / size) + 1).cast("int")).drop("_sent")


def send_batches(
    docs: DataFrame, send: Callable[[pa.Table], None], keys: Sequence[str] = ("page_id",), order: Sequence[str] = ("position",), size: int = BATCH
) -> int:
    """Hand the documents to ``send`` from the tasks, as tables of at most ``size`` rows of one page, in order.

    Pages are brought together and sorted by Spark; a task holds one page's latest rows at a time. Gives the number of tables.
    """
    sorted_docs = docs.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, page, sent = None, None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keyed = table.select(list(keys)).to_pylist()
            cuts = [0, *(i for i in range(1, len(keyed)) if keyed[i] != keyed[i - 1]), len(keyed)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if held is not None and keyed[lo] != page:
                    send(held)
                    held, sent = None, sent + 1
                page, rows = keyed[lo], table.slice(lo, hi - lo)
                held = rows if held is None else pa.concat_tables([held, rows])
                while held.num_rows > size:
                    send(held.slice(0, size))
                    held, sent = held.slice(size), sent + 1
        if held is not None:
            send(held)
            sent += 1
        yield pa.RecordBatch.from_pydict({"sent": [sent]})

    return sorted_docs.mapInArrow(run, "sent long").agg(F.coalesce(F.sum("sent"), F.lit(0))).first()[0]


def add_extra(docs: DataFrame, extra: DataFrame) -> DataFrame:
    """Append given records after the crawl."""
    return docs.unionByName(extra, allowMissingColumns=True)


def latest_by_id(docs: DataFrame, version: Column) -> DataFrame:
    """One document per id, the one with the highest version. Filtered map-side before the shuffle."""
    w = Window.partitionBy("objectID").orderBy(version.desc())
    return docs.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, version: Column | None = None) -> DataFrame:
    """New documents replace old ones with the same id. Of new ones that share an id one stays: the one with the highest
    ``version``, by default the largest hash of its plain columns."""
    plain = [c for c, kind in new.dtypes if not kind.startswith(("map", "struct", "array"))]
    new = latest_by_id(new, F.xxhash64(*plain) if version is None else version)
    kept = old.join(new.select("objectID"), "objectID", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def prefix_test(url: Column, prefixes: Sequence[str]) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(url, p)), F.lit(False))


def delete_prefixes(docs: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Drop the documents whose URL starts with any of the prefixes."""
    return docs.filter(~prefix_test(F.col("url"), prefixes)) if prefixes else docs


def partial_update(old: DataFrame, new: DataFrame, only_urls: Sequence[str]) -> DataFrame:
    """Replace what is stored below the given URLs by the new documents."""
    return upsert(delete_prefixes(old, only_urls), new)


def rebuild(docs: DataFrame, root: str, number: int | None = None) -> int:
    """Publish ``docs`` as the next version of the index at ``root``, or as the given one.

    The version is written first, into a folder of its own. Only when it is whole is it entered in the list of published
    versions, so a job that fails half-way changes nothing for readers.
    """
    spark = docs.sparkSession
    number = (published(spark, root) or 0) + 1 if number is None else number
    folder = f"version={number}-{uuid.uuid4().hex}"
    docs.write.parquet(f"{root}/{folder}")
    spark.createDataFrame([(number, folder)], _PUBLISHED).coalesce(1).write.mode("append").parquet(f"{root}/published")
    return number


_PUBLISHED = "number long, folder string"


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_PUBLISHED).parquet(f"{root}/published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def published(spark: SparkSession, root: str) -> int | None:
    """Number of the latest published version."""
    versions = _versions(spark, root)
    return None if versions is None else versions.agg(F.max("number")).first()[0]


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The latest published version."""
    versions = _versions(spark, root)
    if versions is None:
        raise ValueError(f"nothing is published at {root}")
    latest = versions.orderBy(F.desc("number"), F.desc("folder")).first()
    return spark.read.parquet(f"{root}/{latest['folder']}")


def summary(records: DataFrame, url: str = "url_without_anchor", flag: str | None = None) -> DataFrame:
    """Records per page."""
    return records.groupBy(url, *([flag] if flag else [])).agg(F.count(F.lit(1)).alias("records"))


def total_hits(per_page: DataFrame) -> DataFrame:
    return per_page.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("hits"))


def require_hits(records: DataFrame) -> None:
    """A run without records is an error."""
    if records.isEmpty():
        raise ValueError("no records")
