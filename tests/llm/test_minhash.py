import random
import re

import numpy as np
import pyarrow as pa

from frameloom.llm import components, minhash, textnum


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" if i % 3 else f"É{i}a" for i in range(400)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append((" ".join(copy) if rng.random() < 0.8 else "\n\t".join(copy).upper()))
    return list(enumerate(texts[:n]))


def test_components_match_brute_force(spark):
    rows = corpus(300, 5)
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "A b"), (1004, "a  B"), (1005, "one"), (1006, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, kept int, rep int")
    got = {
        r.doc_id: (r.n_shingles, r.component_id)
        for r in minhash.near_duplicates(docs, words=4).collect()
    }
    want = brute(rows, 4, 80)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_a_chain_is_one_component(spark):
    """Neighbours are similar, the ends are not: links must not be lost."""
    base = [f"a{i}" for i in range(200)]
    rows = []
    for step in range(40):
        rows.append((step, " ".join([f"b{i}" for i in range(step * 5)] + base[step * 5 :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=4).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4, 80).items()}
    assert set(got.values()) == {0}


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == 3 and all(r.kept for r in rows)


def test_signature_agrees_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        hits = []
        for _ in range(30):
            common = textnum.mix(rng.integers(0, 1 << 62, 1000).astype(np.uint64))
            n = int(len(common) * share * 2 / (1 + share))
            a = np.concatenate([common[:n], textnum.mix(rng.integers(0, 1 << 62, 1000 - n).astype(np.uint64))])
            b = np.concatenate([common[:n], textnum.mix(rng.integers(0, 1 << 62, 1000 - n).astype(np.uint64))])
            hits.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(hits) - n / (2000 - n)) < 0.03


def test_words_follow_the_definition():
    texts = ["", None, " a\x0bb c ", "x", "\n\n", "é è\tÀB"]
    data, offs = textnum.utf8(pa.array(texts))
    s, e, at = textnum.word_spans(data, offs)
    found = [[bytes(data[s[j] : e[j]]).decode() for j in range(at[i], at[i + 1])] for i in range(len(texts))]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}}
