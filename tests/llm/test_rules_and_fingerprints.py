"""Quality rules, SimHash and Lempel-Ziv fingerprints against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import TESTDATA
from pyspark.sql import functions as F

from docrecords.llm import lz_fingerprint as Z
from docrecords.llm import quality_rules as Q
from docrecords.llm import simhash as S
from docrecords.llm.components import components


def counted(text):
    import re

    text = text or ""
    words = re.findall("[^ \t\n\x0b\x0c\r]+", text)
    lines = [x for x in text.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_counted_rules(spark, documents, labels):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = Q.op8_quality_rules(spark, TESTDATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert base(r) == counted(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)
    known = {r.doc_id: r.quality for r in labels.collect()}
    by = [(r.kept, known[r.doc_id]) for r in rows if r.doc_id in known and not r.base_failed]
    assert sum(k for k, q in by if q) >= 0.98 * sum(q for _, q in by)
    assert sum(k for k, q in by if not q) <= 0.1 * sum(not q for _, q in by)


def test_counted_rules_on_odd_texts(spark, odd, none, labels):
    random.seed(3)
    more = [(100 + i, " ".join(random.choices("abc", k=random.randint(0, 30))) + random.choice(["\n", " \n \n", "\n#|<"]) * i) for i in range(40)]
    df = odd.select("doc_id", "text", F.lit(1).alias("kept")).unionByName(spark.createDataFrame([(*m, 1) for m in more], "doc_id long, text string, kept int"))
    texts = [(r.doc_id, r.text) for r in df.collect()]
    rows = Q.quality_rules(df, labels).collect()
    assert sorted(map(str, ((r.doc_id, base(r)) for r in rows))) == sorted(map(str, ((i, counted(t)) for i, t in texts)))
    assert Q.keep_good(df, labels).columns == df.columns
    assert Q.quality_rules(none, labels).count() == 0
    assert {r.ratio for r in Q.quality_rules(df, labels.limit(0)).collect()} == {0.0}


def test_ratios_equal_a_plain_count(spark):
    docs = [(1, "aa bb cc"), (2, "aa dd"), (3, "ee aa aa"), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = Q.RatioModel(buckets=64, smoothing=3.0)
    counts = Q.bucket_counts(df, spark.createDataFrame([(1,), (3,)], "_q_id long"), model).collect()
    grams = df.select("doc_id", Q.ngrams(Q.words_of(F.col("text")), 64).alias("g")).collect()
    raw, target = Counter(), Counter()
    for r in grams:
        raw.update(r.g)
        target.update(r.g if r.doc_id in (1, 3) else [])
    assert {r.bucket: (r.raw, r.target) for r in counts} == {b: (n, target[b]) for b, n in raw.items()}
    ratios = Q.bucket_ratios(counts, model)
    n, t = sum(raw.values()), sum(target.values())
    for b, c in raw.items():
        want = np.log(((target[b] + 3.0 * c / n) / (t + 3.0)) / (c / n))
        assert abs(ratios[b] / Q.SCALE - want) < 1e-4


def test_order_of_words_counts(spark):
    random.seed(12)
    follow = {f"w{i}": [f"w{random.randrange(40)}" for _ in range(2)] for i in range(40)}

    def clean():
        words = ["w0"]
        while len(words) < 80:
            words.append(random.choice(follow[words[-1]]))
        return words

    texts = [clean() for _ in range(300)]
    junk = [random.sample(t, len(t)) for t in texts[200:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.ratio for r in Q.quality_rules(df, labels).collect()}
    # the same words in another order
    assert all(got[300 + i] < got[200 + i] - 0.1 for i in range(100))


def test_all_trusted_rows_count(spark):
    df = spark.range(20_400).select(F.col("id").alias("doc_id"), F.format_string("a%d b%d c", "id", F.col("id") % 7).alias("text"))
    labels = df.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    # where all documents are trusted, target and raw text are the same
    assert {r.ratio for r in Q.quality_rules(df, labels).collect()} == {0.0}


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=2):
    root = {f: f for f in fps}
    arr = np.array(sorted(set(fps)), np.uint64)
    changed = True
    while changed:
        changed = False
        for f in arr.tolist():
            least = min(root[g] for g in arr[np.bitwise_count(arr ^ np.uint64(f)) <= radius].tolist())
            if least != root[f]:
                root[f], changed = least, True
    return root


def test_simhash_of_documents(spark, documents):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    fps = {i: plain_fingerprint(t) for i, t in texts}
    root = plain_components(list(fps.values()))
    first = {}
    for i, f in sorted(fps.items()):
        first.setdefault(root[f], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op10_simhash(spark, TESTDATA).collect()}
    assert got == {i: (f"{f:016x}", first[root[f]]) for i, f in fps.items()}


@pytest.mark.parametrize("unit, largest", [(1 << 13, 1 << 19), (4, 40)])
def test_near_links_find_all_components(spark, unit, largest):
    random.seed(8)
    fps = {random.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:12]:
        for _ in range(30):
            g = f
            for _ in range(random.randint(1, 5)):
                g ^= 1 << random.randrange(64)
            fps.add(g)
    # a chain, and a crowd below one long prefix
    fps |= {(1 << k) - 1 for k in range(64)} | {0xABCD << 48 | random.getrandbits(10) for _ in range(200)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = components(S.near_links(spark.createDataFrame(signed, "fp long"), 2, unit, largest)).collect()
    root = plain_components(list(fps))
    group = {n % (1 << 64): r % (1 << 64) for n, r in ((x.node, x.root) for x in found)}
    mine = {f: group.get(f, f) for f in fps}
    assert len({(mine[f], root[f]) for f in fps}) == len(set(mine.values())) == len(set(root.values()))


def test_components_of_a_graph(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (102, 102), (7, 200), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 200: 0, 101: 100, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_rows(odd, none):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].fp for i in (1, 2, 3)] == [0, 0, 0] and {by_id[i].component_id for i in (1, 2, 3)} == {1}
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    # 6, 6 and 7 have the same words, and 1, 2 and 3 have none
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "10", "4", "5", "6", "8", "9", "None"])
    assert S.near_duplicates(none).count() == 0 and S.keep_one(none).count() == 0


def plain_phrases(text):
    seen, open_ = set(), ""
    for c in text:
        open_ += c
        if open_ not in seen:
            seen.add(open_)
            open_ = ""
    return seen


def check_pairs(rows, texts):
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        a, b = t or "", order[(k + 1) % len(order)][1] or ""
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        fa, fb, fe = (Z.smallest(plain_phrases(x)) for x in (a, b, e))
        want.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), Z.text_of(fa), Z.text_of(fe), Z.likeness(fa, fe), Z.likeness(fa, fb)))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_phrase_fingerprints(spark, documents, odd, none):
    check_pairs(Z.op4_lz_fingerprint(spark, TESTDATA).collect(), [(r.doc_id, r.text) for r in documents.collect()])
    check_pairs(Z.lz_fingerprints(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert Z.lz_fingerprints(none).count() == 0
    one = odd.filter("doc_id = 7")
    assert [r.near_next for r in Z.lz_fingerprints(one).collect()] == [1.0]


def test_likeness_estimates_the_shared_phrases():
    random.seed(6)
    words = ["".join(random.choices("abcdefgh", k=5)) for _ in range(300)]
    a = " ".join(random.choices(words, k=3000))
    for share in (0.0, 0.5, 1.0):
        b = a[: int(share * len(a))] + " ".join(random.choices(words, k=3000))[int(share * len(a)) :]
        x, y = plain_phrases(a), plain_phrases(b)
        true = len(x & y) / len(x | y)
        assert abs(Z.likeness(Z.fingerprint(a), Z.fingerprint(b)) - true) < 0.15
