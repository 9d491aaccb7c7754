"""Near-duplicates of the pipeline against all pairs by exact Jaccard similarity."""

import random

import numpy as np
from helpers import LARGER

import corpus_pipeline
from docrecords.llm import alike as A
from docrecords.llm.simhash import shingle_hashes


def brute(rows):
    """Smallest id of the component of each id, and the pairs of unequal sets that are linked."""
    sets = {i: frozenset(shingle_hashes(t, 5).tolist()) for i, t in rows}
    holders, root, links = {}, {i: i for i in sets}, []
    for i in sorted(sets):
        near = {}
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                near[j] = near.get(j, 0) + 1
            holders[s].append(i)
        for j, both in near.items():
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                links.append((j, i, sets[i] == sets[j]))
    for a, b, _ in links:
        a, b = find(root, a), find(root, b)
        root[max(a, b)] = min(a, b)
    return {i: find(root, i) for i in sets}, [(a, b) for a, b, same in links if not same]


def find(root, i):
    while root[i] != i:
        i = root[i]
    return i


def test_stage_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").filter("length(text) > 200")
    root, links = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(links) >= 10
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, LARGER).collect()}
    assert kept == {i for i, r in root.items() if i == r}


def test_similarity_at_the_edge_and_clean_texts(spark):
    random.seed(4)
    rows, alike = [], set()
    for k in range(60):
        words = [f"w{random.randrange(5000)}" for _ in range(150)]
        rows.append((10 * k, " ".join(words)))
        # each changed word far from the others changes 5 shingles of 146
        for n, places in enumerate(([75], [30, 75, 120], [20, 45, 70, 95, 120])):
            changed = [f"x{k}{n}" if i in places else w for i, w in enumerate(words)]
            rows.append((10 * k + 1 + n, " ".join(changed)))
    root, links = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in A.alike(df).collect()}
    assert got == root
    assert {i % 10 for i in got if got[i] == i} == {0, 3} and links


def test_band_keys_reach_the_recall():
    rng = np.random.default_rng(2)
    hit = 0
    for _ in range(400):
        a = rng.integers(1 << 63, size=180, dtype=np.uint64)
        b = np.concatenate([a[20:], rng.integers(1 << 63, size=20, dtype=np.uint64)])
        hit += bool(set(A.band_keys(a)) & set(A.band_keys(b)))
    assert hit >= 396
