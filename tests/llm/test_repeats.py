import hashlib
import random

from helpers import TESTDATA

from docrecords.llm import repeats as R


def brute(rows, size=50):
    """Bytes covered by a passage that also starts in a document with a smaller id."""
    datas = [(10**18 if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, data in datas:
        for s in range(len(data) - size + 1):
            p = data[s : s + size]
            least[p] = min(least.get(p, i), i)
    out = []
    for (i, _), (number, data) in zip(rows, datas):
        gone = bytearray(len(data))
        for s in range(len(data) - size + 1):
            if least[data[s : s + size]] < number:
                gone[s : s + size] = b"\1" * size
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def want(rows):
    return sorted(map(str, brute(rows)))


def test_cover_has_every_difference():
    assert {(a - b) % R.PERIOD for a in R.COVER for b in R.COVER} == set(range(R.PERIOD))


def test_random_overlaps(spark, monkeypatch):
    random.seed(2)
    passages = ["".join(random.choices("abcé", k=random.randint(40, 130))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = random.choices([*passages, "x" * 70, "", "né"], k=random.randint(0, 4))
        text = "".join(p[random.randint(0, 3) :] + random.choice(["", "zq", "1"]) for p in parts)
        rows.append((random.randint(0, 90), text))
    rows += [(None, passages[0] * 2), (None, passages[0] * 2), (5, None), (200, "x" * 5000), (201, "x" * 49), (202, "y" * 51)]
    df = spark.createDataFrame([(*r, 1, b"1") for r in rows], "doc_id long, text string, n int, data binary").repartition(3)
    assert got(R.without_repeats(df)) == want(rows)
    assert got(R.without_repeats(df.limit(0))) == []


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").collect()]
    found = R.op7_suffix_repeats(spark, TESTDATA)
    assert got(found) == want(rows)
    assert sum(r.n_removed for r in found.collect()) > 1000
