"""Running values, fill-down and caps against plain Python on random rows."""

import random

import pytest
from pyspark.sql import functions as F

from docrecords.operators import crawl as C
from docrecords.operators import hierarchy as H
from docrecords.operators import index as I
from docrecords.operators.prefix import running


def rows_of(seed, groups=5, n=400):
    rnd = random.Random(seed)
    out = []
    for nid in rnd.sample(range(5 * n), n):
        # one group holds most of the rows, one has no key
        page = rnd.choice([0, 0, 0, 0, None] + list(range(1, groups)))
        lvl = rnd.choice([0, 1, 2, 3, 4, 5, 6, 7, 7, 7])
        text = rnd.choice([None, f"t{nid}", f"t{nid}"])
        anchor = rnd.choice([None, "", f"a{nid}"]) if lvl < 7 else None
        out.append((page, nid, lvl, text, anchor))
    return out


SCHEMA = "page_id int, nid int, lvl int, text string, anchor string"


def expected(rows):
    out = {}
    for page in {r[0] for r in rows}:
        levels, anchors = [None] * 7, [None] * 7
        for position, (_, nid, lvl, text, anchor) in enumerate(sorted((r for r in rows if r[0] == page), key=lambda r: r[1])):
            if lvl < 7:
                levels[lvl], anchors[lvl] = text, anchor
                levels[lvl + 1 :] = anchors[lvl + 1 :] = [None] * (6 - lvl)
            best = next((a for a in reversed(anchors) if a is not None), None)
            out[page, nid] = (position, *levels, best)
    return out


@pytest.mark.parametrize("large", [False, True])
def test_fill_down(spark, large):
    rows = rows_of(1)
    df = H.fill_down(spark.createDataFrame(rows, SCHEMA), ["page_id"], "nid", large=large, position="position")
    got = {
        (r.page_id, r.nid): (r.position, *[r[f"lvl{k}"] for k in range(7)], r.anchor) for r in df.collect()
    }
    assert got == expected(rows)


def test_large_groups_with_sparse_orders_of_any_type(spark):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("nid", F.timestamp_seconds(F.col("nid").cast("long") * 1_000_003))
    df = H.add_position(df, ["page_id"], "nid", large=True)
    want = {(k[0], k[1] * 1_000_003): v[0] for k, v in expected(rows).items()}
    got = df.select("page_id", F.unix_seconds("nid").alias("nid"), "position").collect()
    assert {(r.page_id, r.nid): r.position for r in got} == want


def test_batches(spark):
    docs = spark.range(260).select((F.col("id") % 2).alias("page"), F.col("id").alias("position"))
    for large in (False, True):
        got = I.add_batches(docs, ["page"], "position", large=large).groupBy("page", "batch").count().collect()
        assert sorted((r.page, r.batch, r["count"]) for r in got) == [
            (p, b, 50 if b < 3 else 30) for p in (0, 1) for b in (1, 2, 3)
        ]


def test_send_batches(spark, tmp_path):
    folder = str(tmp_path)

    def send(table):
        import json
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump(table.to_pydict(), f)

    docs = spark.range(320).select((F.col("id") % 3).alias("page_id"), F.col("id").alias("position"), F.lit("x").alias("objectID"))
    assert I.send_batches(docs.repartition(4), send) == 9
    import json

    lists = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert all(len(set(t["page_id"])) == 1 and t["position"] == sorted(t["position"]) for t in lists)
    assert sorted(len(t["page_id"]) for t in lists) == [6, 7, 7, 50, 50, 50, 50, 50, 50]
    assert sorted(p for t in lists for p in t["position"]) == list(range(320))
    assert I.send_batches(docs.limit(0), send) == 0


def test_a_failed_rebuild_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "index")
    I.rebuild(spark.range(3).withColumnRenamed("id", "objectID"), root)
    broken = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("long")).alias("objectID"))
    with pytest.raises(Exception, match="no"):
        I.rebuild(broken, root)
    assert I.read_index(spark, root).count() == 3 and I.published(spark, root) == 1
    I.rebuild(spark.range(7).withColumnRenamed("id", "objectID"), root)
    assert I.read_index(spark, root).count() == 7 and I.published(spark, root) == 2
    with pytest.raises(ValueError):
        I.read_index(spark, str(tmp_path / "none"))


def test_upsert_keeps_one_of_each_new_id(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "objectID string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "objectID string, v int")
    got = sorted((r.objectID, r.v) for r in I.upsert(old, new, version=F.col("v")).collect())
    assert got == [("a", 1), ("b", 4), ("c", 5)]
    assert I.upsert(old, new).count() == 3


def test_require_hits(spark):
    I.require_hits(spark.range(1))
    with pytest.raises(ValueError):
        I.require_hits(spark.range(0))


def test_hit_cap(spark):
    rows = [(i, i % 3 == 0, (i * 7) % 11) for i in range(60)]
    per_page = spark.createDataFrame(rows, "page_id int, from_sitemap boolean, records int")
    total, kept = 0, []
    for page, _, n in sorted(rows, key=lambda r: (not r[1], r[0])):
        if total <= 120:
            kept.append((page, total))
        total += n
    got = C.cap_pages(per_page, 120)
    assert sorted((r.page_id, r.before) for r in got.collect()) == sorted(kept)
    assert C.cap_pages(per_page, 0).count() == 60
    assert C.cap_records(per_page, per_page, 120).count() == len(kept)


def test_running_sum_needs_no_group(spark):
    df = running(spark.range(50), [], "id", sums={"before": F.col("id")}, large=True)
    assert {r.id: r.before for r in df.collect()} == {i: sum(range(i)) for i in range(50)}
