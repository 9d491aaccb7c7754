import hashlib
import re

from helpers import TESTDATA
from pyspark.sql import functions as F

from docrecords.llm import pii

TRICKY = [
    (1, None),
    (2, ""),
    (3, "a@b.com_x@c.d, a@b, @x.y, a@b..c, é@x.fr x@é.fr q@a.b.c.d."),
    (4, "1.2.3.4 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0255 1..2.3.4 999999999999.1.1.1"),
    (5, "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111 0000000000000000000000"),
    (6, "+1 (555) 123-4567, +12, ++44 20 7946 0958, +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6"),
    (7, "日本😀 +49 (30) 1234567 日 a.b@ex.org 10.0.0.1 " * 3),
    (8, "a" * 20000),
    (9, "1" * 20000 + " " * 3000 + "+1" + " " * 5000),
    (10, "x@y" + ".z" * 5000),
    (10, "x@y" + ".z" * 5000),
    (11, "call 555-123-4567 or mail joe [at] site [dot] org"),
]
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in hit.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base_spans(text):
    return [
        (kind, m.start(), m.end()) for kind, pattern in KINDS.items() for m in re.finditer(pattern, text) if passes(kind, m[0])
    ]


def check(rows, texts):
    assert len(rows) == len(texts)
    for row in rows:
        want = base_spans(texts[row.doc_id] or "")
        assert [getattr(row, f"n_{k}") for k in KINDS] == [sum(s[0] == k for s in want) for k in KINDS], row.doc_id
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert row.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), row.doc_id
        listed = [s for s in row.spans.split(",") if s]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(listed)
        assert listed == sorted(listed, key=lambda s: (list(KINDS).index(s.split(":")[0]), int(s.split(":")[1])))


def test_tricky_texts(spark, tmp_path):
    df = spark.createDataFrame(TRICKY, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    # repeated rows are judged each
    rows = pii.op5_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(TRICKY)
    check(rows, Repeated(TRICKY))


class Repeated(dict):
    def __init__(self, rows):
        super().__init__(rows)
        self.n = len(rows)

    def __len__(self):
        return self.n


def test_documents(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.op5_pii(spark, TESTDATA).collect()
    check(rows, texts)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 5


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.com or +1 (555) 123-4567!", 7), (2, None, 8), (3, "nothing", 9)], "doc_id long, text string, spans int")
    got = {r.doc_id: (r.text, r.spans) for r in pii.redacted(df).collect()}
    assert got == {1: ("mail [EMAIL] or [PHONE]!", 7), 2: (None, 8), 3: ("nothing", 9)}


def test_odd_rows(odd, none):
    assert pii.redacted(odd).count() == odd.count()
    assert pii.redacted(none).columns == none.columns and pii.redacted(none).count() == 0


def test_trees_find_the_pattern_and_calibrate():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (500, 9))
    x[:, 0] = 2
    y = ((x[:, 1] > 1) & (x[:, 4] < 2)).astype(float)
    model = pii.fit(x, y, np.ones(500), np.arange(500) % 5 == 0, pii.Training())
    score = np.full(500, model.start)
    for (f, at), *sides in model.trees:
        low, high = (np.where(x[:, g] <= to, a, b) for (g, to), a, b in sides)
        score += np.where(x[:, f] <= at, low, high)
    assert ((score >= model.limits[2]) == (y == 1)).mean() > 0.97
    assert model.limits[0] == float("inf")


def test_scores_in_sql_equal_those_of_the_fit(spark):
    model = pii.Boosted(0.5, ((((1, 2), ((0, 0), 1.0, 2.0), ((2, 1), 3.0, 4.0))),), (0.0,) * 4)
    df = spark.createDataFrame([(0, 1, 0), (1, 2, 0), (0, 3, 1), (0, 3, 2)], "kind int, digits int, marks int")
    got = [r[0] for r in df.select(model.score(F.struct("*"))).collect()]
    assert got == [1.5, 2.5, 3.5, 4.5]
