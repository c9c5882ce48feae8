"""Chunk scoring: isolation of failures, scorers made once, odd texts."""

import pytest

from grafita.operators import scorers as sr


def test_isolation_calls_few_and_loses_none():
    calls = []

    def scorer(batch):
        calls.append(len(batch))
        if any("bad" in t for _, t in batch):
            raise ValueError("bad one")
        return [[("t", 1.0, float(len(t)))] for _, t in batch]

    batch = [("", "x" * i) for i in range(1, 200)] + [("", "bad")] + [("", "y")] * 56
    out = sr.isolated(scorer, batch)
    assert [o[1] for o in out].count(None) == 255 and out[199] == ([], "ValueError: bad one") and out[3][0] == [("t", 1.0, 4.0)]
    assert len(calls) <= 2 * 8 + 1
    assert [e for _, e in sr.isolated(lambda b: [[]], [("", "a"), ("", "b")])] == [None, None]  # wrong number for two, right for one


def test_scores_ranks_and_odd_texts(spark):
    made = []

    def factory():
        made.append(1)
        return lambda batch: [[("b", 0.4, 1.0), ("a", 0.4, 1.0), ("low", 0.07, 0.0), ("edge", 0.08, 0.0)] if t != "nan" else [("a", float("nan"), 0.0)] for _, t in batch]

    rows = [(1, "one"), (2, None), (3, " \t\n"), (4, "nan"), (1, "one"), (None, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    got = sorted(map(tuple, sr.score_chunks(df, "test", factory, batch_rows=2).collect()), key=repr)
    best = [("a", 0.4, 1.0, 1, None), ("b", 0.4, 1.0, 2, None), ("edge", 0.08, 0.0, 3, None)]
    want = [(k, *b) for k in (1, 1, None) for b in best] + [(4, None, None, None, None, "BertExtractionError: ValueError: a probability is no number")]
    assert got == sorted(want, key=repr)
    assert sr.score_chunks(df.limit(0), "test", factory).count() == 0
    assert sr.scorer_of("once", factory) is sr.scorer_of("once", factory) and len(made) == 1


def test_keyword_scorer():
    score = sr.keyword_scorer({"a": ["x"], "b": ["y"]}, "!")()
    assert [t for t, p, z in max([score([("", "x x")])[0]]) if p > 0.5] == ["a"]
    with pytest.raises(RuntimeError):
        score([("", "ok"), ("", "no!")])
