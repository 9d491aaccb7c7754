import random

import numpy as np
import pytest
import sentencepiece
from helpers import TESTDATA
from pyspark.sql import functions as F

from docrecords.llm import sentencepiece_stream as S

SP = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
PARTS = ["a", "the", "ing", " ", "  ", "   ", "\n", "\n\n", "é", "日本", "▁", "=", "----", "\t", "1", "\0", "😀", "\xa0", "</s>", "[INST]", "ñq", ".\n", ",#"]


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary(S.model_bytes(S.MODEL))


def test_equals_the_library_on_random_texts(vocabulary):
    random.seed(5)
    segments = S.Segments(vocabulary, 50)
    for _ in range(3000):
        text = "".join(random.choices(PARTS, k=random.randint(0, 12)))
        ids = np.frombuffer(S.encode(text, vocabulary, segments), np.int32).tolist()
        assert ids == SP.encode(text), repr(text)
        assert S.decode(ids, vocabulary) == SP.decode(ids), repr(text)


def test_streaming_commits_early_and_holds_a_bounded_window(vocabulary):
    text = vocabulary.normalize("the cat sat on =-=a " * 400 + "x" * 3000 + "日本" * 500)
    encoder, ids, widest, early = S.Encoder(vocabulary), [], 0, 0
    for at in range(0, len(text), 7):
        ids += encoder.feed(text[at : at + 7])
        widest = max(widest, len(encoder.window))
        early = len(ids)
    ids += encoder.finish()
    # one long run of equal letters keeps several paths open for a while; elsewhere they meet soon
    assert widest <= 12 * vocabulary.longest and early > 0.9 * len(ids)
    whole = np.frombuffer(S.encode("the cat sat on =-=a " * 400 + "x" * 3000 + "日本" * 500, vocabulary, S.Segments(vocabulary, 9)), np.int32)
    assert ids == whole.tolist() == SP.encode("the cat sat on =-=a " * 400 + "x" * 3000 + "日本" * 500)


def test_unigram_paths_have_the_best_score():
    class Small:
        bpe, longest, unknown_score = False, 3, -20.0
        ids = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4, "bb": 5}
        scores = [-2.0, -2.5, -3.0, -2.2, -5.5, -4.0]
        endings = {"ab": (2,), "ba": (3, 2), "bb": (2,)}

        def fallback(self, char):
            return [9]

    def best(text):
        if not text:
            return 0.0, []
        tries = []
        for n in (1, 2, 3):
            if len(text) >= n and (text[:n] in Small.ids or n == 1):
                score, ids = best(text[n:])
                own = Small.ids.get(text[:n])
                tries.append((score + (Small.scores[own] if own is not None else -20.0), [9 if own is None else own, *ids]))
        return max(tries)

    random.seed(1)
    for _ in range(200):
        text = "".join(random.choices("abc", k=random.randint(0, 14)))
        encoder = S.Encoder(Small())
        ids = []
        for at in range(0, len(text), 5):
            ids += encoder.feed(text[at : at + 5])
        ids += encoder.finish()
        score = sum(-20.0 if i == 9 else Small.scores[i] for i in ids)
        assert score == pytest.approx(best(text)[0])


def test_query_round_trips(spark):
    rows = S.op1_sentencepiece(spark, TESTDATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == SP.encode(texts[r.doc_id]) and r.n_ids == len(r.ids) and r.same_text


def test_odd_rows(odd, none):
    rows = S.with_ids(odd, back="again").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.ids is None) if r.text is None else r.ids == SP.encode(r.text)
    assert S.with_text(S.with_ids(odd)).filter(~F.col("text").contains("▁") & ~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert S.with_ids(none).count() == 0
