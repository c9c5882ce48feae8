"""Importance resampling against zlib and plain Python."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from grafita.llm import importance, registry

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(t, longest):
    w = WORD.findall((t or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, share, min_words, buckets, longest):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, x in docs:
        for g in grams(x, longest)[1]:
            s[bucket(g)] += 1
    for x in target:
        for g in grams(x, longest)[1]:
            t[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out, fit = [], []
    for i, (key, x) in enumerate(docs):
        w, g = grams(x, longest)
        weight = sum(gain[bucket(y)] for y in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(w) >= min_words:
            fit.append(i)
    fit.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0, out[i][1], out[i][2]))
    for n, i in enumerate(fit[: share * len(fit) // 100]):
        out[i][4] = n + 1
    return sorted(map(tuple, out), key=repr)


def cases():
    rng = random.Random(3)
    pool = ["Alpha", "b", "été", "naïve", "ÉTÉ", "x9", "日本語", "😀", "zeta"] + ["w%d" % i for i in range(300)]
    say = lambda n: "".join(rng.choice(pool) + rng.choice([" ", "\n", "-", "  ", "\x00", "`~", ", "]) for _ in range(n))
    docs = [(i, say(rng.randint(0, 90))) for i in range(200)]
    docs += [(None, say(40)), (None, None), (7, None), (8, ""), (9, "?!"), (10, "x" * 700_000 + " y " * 30), (11, say(60_000)), (12, docs[5][1]), (5, docs[5][1]), (5, docs[5][1])]
    return docs, [say(20) for _ in range(30)] + [None, ""]


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 501)])
def test_resampling_equals_brute_force(spark, longest, buckets):
    docs, target = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'z' score", "1 rank", "2 id")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(d.repartition(4), t, share=30, min_words=20, buckets=buckets, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, 30, 20, buckets, longest)


def test_crc_of_any_part_of_a_stream():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, 70_000).astype(np.uint8)
    c = importance.RunningCrc(x)
    a = np.concatenate([rng.integers(0, len(x), 500), [0, 0, len(x), 256, 255]])
    b = np.concatenate([rng.integers(0, len(x), 500), [0, len(x), len(x), 512, 256]])
    a, b = np.minimum(a, b), np.maximum(a, b)
    assert c.crc32(a, b).tolist() == [zlib.crc32(x[i:j].tobytes()) for i, j in zip(a, b)]
    assert len(importance.RunningCrc(np.zeros(0, np.uint8)).crc32(np.zeros(0, int), np.zeros(0, int))) == 0
    assert importance.Grams(pa.array([None, "", "A-b"])).words.tolist() == [0, 0, 2]


def test_one_key_on_most_rows_and_empty_tables(spark):
    words = " ".join("w%d" % i for i in range(25))
    docs = [(1, words)] * 300 + [(2, words + " more"), (3, "few")]
    t = spark.createDataFrame([("w1 w2",)], "text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = importance.resample(d, t).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 31)) and len(got) == 302
    assert importance.resample(d.limit(0), t).count() == 0
    assert importance.resample(d, t.limit(0)).count() == 302


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = registry.queries()["op11_prefix_crc_resampling"](spark, sf)
    want = con.execute(f"select {', '.join(got.columns)} from ({registry.OP11_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[4] is not None for r in want) > 50
