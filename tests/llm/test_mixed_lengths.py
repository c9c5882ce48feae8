"""Vectors of several lengths in one table: those of the commonest take part; recall near the thresholds."""

import random

import numpy as np

from grafita.llm import ann, embedding_dedup, minhash

SCHEMA = "vec_id long, embedding array<float>"


def test_other_lengths_take_no_part(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    x[31] = x[30]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [0.5] * 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert (got[30].n_links, got[31].component_id, got[31].kept) == (1, 30, False)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (100, 101, 102))
    near = ann.nearest(df, df.where("vec_id in (30, 100, 102)"), k=5).collect()
    assert {r.query_id for r in near} == {30} and not {r.vec_id for r in near} & {100, 101, 102} and len(near) == 5
    assert [r.vec_id for r in near if r["rank"] == 1] == [int(np.argsort(-(x.astype(float) @ x[30].astype(float)) + 1e9 * (np.arange(60) == 30), kind="stable")[0])]


def test_recall_of_pairs_at_the_cosine_threshold(spark):
    rng = np.random.default_rng(2)
    rows, pairs = [], []
    for i in range(400):  # a pair each with a cosine from 0.90 to 0.92
        a, b = rng.standard_normal(64), rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9005, 0.92)
        rows += [(2 * i, a), (2 * i + 1, c * a + np.sqrt(1 - c * c) * b)]
        pairs.append((2 * i, 2 * i + 1))
    rows += [(1000 + i, rng.standard_normal(64)) for i in range(4000)]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], SCHEMA)
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(df).collect()}
    recall = sum(got[a] == got[b] for a, b in pairs) / len(pairs)
    print("recall at cosines of 0.90 to 0.92:", recall)
    assert recall >= 0.97


def test_recall_of_pairs_at_the_jaccard_threshold(spark):
    rng = random.Random(3)
    docs, pairs = [], []
    for i in range(400):
        n = rng.randint(120, 400)
        w = [f"a{i}_{k}" for k in range(n)]
        v = list(w)
        # a changed word ends five shingles of about n; similarity (n - 4 - 5 m) / (n - 4 + 5 m) from 0.80 to 0.82
        m = 1
        while (n - 4 - 5 * (m + 1)) / (n - 4 + 5 * (m + 1)) >= 0.8:
            m += 1
        for j in range(m):
            v[10 + j * ((n - 20) // m)] = f"b{i}_{j}"
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        pairs.append((2 * i, 2 * i + 1))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    recall = sum(got[a] == got[b] for a, b in pairs) / len(pairs)
    print("recall at similarities just above 0.80:", recall)
    assert recall >= 0.9


def test_recall_at_twenty(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    y = x.astype(float)
    hit = 0
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, 6000, 20):
        s = y @ y[q]
        s[q] = -np.inf
        hit += len(found[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    print("recall at k = 20:", hit / (300 * 20))
    assert len(got) == 6000 and hit / 6000 >= 0.9
