import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from frameloom.llm import toxicity


def brute_segments(scores):
    """Maximal segments by their recursive definition: the best one, then both sides."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    right = [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]
    return brute_segments(scores[:i]) + [(i, j, best)] + right


def test_segments_match_the_definition():
    rng = random.Random(3)
    for _ in range(200):
        # steps of different sizes, so that no two segments tie
        scores = np.array([rng.choice([-1, 1]) * (rng.random() + 0.01) for _ in range(rng.randrange(0, 25))])
        got = toxicity.maximal_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in brute_segments(scores.tolist())]


def corpus(n):
    rng = random.Random(11)
    mild, bad = [f"word{i}" for i in range(300)], ["vile", "nasty", "rotten"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(mild) for _ in range(rng.randrange(30, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad).title() + rng.choice(["", ",", "###"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(1500)
    docs += [(5000, None, "x"), (5001, "", "x"), (None, "vile vile", "x"), (5002, "é " * 30_000, "x")]
    labels += [(None, 1, 1), (7, None, None), (9999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rated = toxicity.rate_toxicity(d, lab, prior=0.1)
    rows = {r.doc_id: r for r in rated.collect()}
    assert len(rows) == len(docs)
    truth = {i: t for i, _, t in labels if i is not None and i < 1500 and t is not None}
    held = [i for i in truth if rows[i].held_out]
    assert held and all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert sum(rows[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.5) for r in rows.values())
    assert rows[5000].score == rows[5001].score < 0.5
    # passages lie where the words are
    texts = {i: t for i, t, _ in docs}
    for i in held:
        for p in rows[i].passages:
            assert any(b in texts[i].encode()[p.start : p.end].decode().lower() for b in ("vile", "nasty", "rotten"))


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.rate_toxicity(d, lab).first().predicted == 0
    assert toxicity.rate_toxicity(d.limit(0), lab).count() == 0


def test_hold_out_is_not_learned_from(spark):
    docs, labels = corpus(600)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.rate_toxicity(d, lab).collect()}
    b = {r.doc_id: r.score for r in toxicity.rate_toxicity(d, flipped).collect()}
    assert a == b


def test_few_toxic_labels_are_learned_from(spark):
    rng = random.Random(17)
    mild, bad = [f"word{i}" for i in range(400)], ["vile", "nasty", "rotten"]
    docs, toxic_ids = [], set(range(0, 200, 10))
    for i in range(200):
        words = [rng.choice(mild) for _ in range(60)]
        words[20:20] = rng.sample(bad, 2) if i in toxic_ids else []
        docs.append((i, " ".join(words)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i in toxic_ids)) for i, _ in docs], "doc_id long, toxic int")
    rows = toxicity.rate_toxicity(d, lab).collect()
    # 16 of the 20 are learned from, so each word is in about ten documents
    assert sum(r.held_out for r in rows if r.doc_id in toxic_ids) >= 3
    found = {r.doc_id for r in rows if r.predicted}
    assert len(found & toxic_ids) >= 18 and len(found - toxic_ids) <= 4


def test_segments_of_a_long_falling_text_take_linear_time():
    import time

    scores = np.tile([1.0, -1.5], 100_000)
    began = time.perf_counter()
    assert len(toxicity.maximal_segments(scores)) == 100_000
    assert time.perf_counter() - began < 10
