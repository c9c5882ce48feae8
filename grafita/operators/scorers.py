"""Scoring of chunks by an injected model: made once a worker, failures kept to their rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A batch of (title, text) to the (topic, probability, logit) of each.
Scorer = Callable[[Sequence[tuple[str, str]]], Sequence[Sequence[tuple[str, float, float]]]]

_made: dict[str, Scorer] = {}
_SCORES = "topic string, prob double, logit double, rank int, error string"


def scorer_of(name: str, factory: Callable[[], Scorer]) -> Scorer:
    """The scorer of a name; this process makes it the first time it is asked for and keeps it."""
    if name not in _made:
        _made[name] = factory()
    return _made[name]


def isolated(scorer: Scorer, batch: Sequence[tuple[str, str]]) -> list[tuple[Sequence[tuple[str, float, float]], str | None]]:
    """Scores of each of a batch; one that fails is halved until single texts carry the errors.

    A scorer that gives another number of results than texts has failed, too.  With f bad
    texts of n, about f * log2(n) calls fail.
    """
    try:
        out = list(scorer(batch))
        if len(out) != len(batch):
            raise ValueError(f"{len(out)} results for {len(batch)} texts")
        return [(x, None) for x in out]
    except Exception as e:  # noqa: BLE001 - a failure is a result
        if len(batch) == 1:
            return [([], f"{type(e).__name__}: {e}")]
        half = len(batch) // 2
        return isolated(scorer, batch[:half]) + isolated(scorer, batch[half:])


def score_chunks(chunks: DataFrame, name: str, factory: Callable[[], Scorer], least: float = 0.08, batch_rows: int = 64, batch_chars: int = 1 << 20) -> DataFrame:
    """A row for each topic of a chunk with a probability of at least ``least``, best first, or for its error.

    chunks: chunk_id, text and, if there is one, title.  Blank and null texts give no row.
    ``factory`` makes the scorer once a worker process; ``name`` tells scorers apart.  It is
    called with at most ``batch_rows`` texts and, single ones aside, ``batch_chars``
    characters.  Ties go by topic; a probability that is no number counts as an error.
    Columns: chunk_id, topic, prob, logit, rank (from 1), error (BertExtractionError of a row
    whose topic is null).
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in chunks.columns else F.lit("")
    rows = chunks.select(F.col("chunk_id"), title.alias("title"), F.col("text")).where(F.col("text").rlike(r"\S"))

    def pieces(texts: list[tuple[str, str]]) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and to - at < batch_rows and (to == at or chars + len(texts[to][1]) <= batch_chars):
                chars += len(texts[to][1])
                to += 1
            yield at, to
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or scorer_of(name, factory)
            texts = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for at, to in pieces(texts):
                take, out = [], []
                for i, (scores, error) in enumerate(isolated(scorer, texts[at:to])):
                    good = sorted(((str(t), float(p), float(z)) for t, p, z in scores), key=lambda s: (-s[1], s[0]))
                    if any(p != p for _, p, _ in good):
                        good, error = [], "ValueError: a probability is no number"
                    found = [(t, p, z, n + 1, None) for n, (t, p, z) in enumerate(s for s in good if s[1] >= least)] if error is None else [(None, None, None, None, f"BertExtractionError: {error}")]
                    take += [at + i] * len(found)
                    out += found
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *map(pa.array, columns, kinds)], ["chunk_id", "topic", "prob", "logit", "rank", "error"])

    return rows.mapInArrow(run, f"chunk_id {kind}, {_SCORES}")


def keyword_scorer(topics: dict[str, Sequence[str]], refuse: str | None = None) -> Callable[[], Scorer]:
    """A factory of scorers that count keywords: logits are counts, probabilities their softmax.

    A text that holds ``refuse`` makes the whole batch raise, as a model does that meets
    what it can't take.
    """

    def factory() -> Scorer:
        from math import exp

        def score(batch: Sequence[tuple[str, str]]) -> list[list[tuple[str, float, float]]]:
            out = []
            for _, text in batch:
                if refuse is not None and refuse in text:
                    raise RuntimeError(f"can't take {refuse}")
                low = text.lower()
                z = {t: float(sum(low.count(w) for w in words)) for t, words in topics.items()}
                top = max(z.values())
                total = sum(exp(v - top) for v in z.values())
                out.append([(t, exp(v - top) / total, v) for t, v in z.items()])
            return out

        return score

    return factory
