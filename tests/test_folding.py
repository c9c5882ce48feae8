"""Folding against Python's own Unicode data, for every character of the first plane and beyond."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from grafita.functions import text as tx


def fold(s):
    d = unicodedata.normalize("NFD", s.lower())
    return unicodedata.normalize("NFC", "".join(c for c in d if unicodedata.category(c) != "Mn" or c == "̃"))


def rid(s):
    d = unicodedata.normalize("NFKD", s.lower())
    d = unicodedata.normalize("NFC", "".join(c for c in d if not unicodedata.combining(c) or c == "̃"))
    return re.sub(r"[^a-z0-9]+", "_", d).strip("_")


def assigned():
    """Characters that Java 17 knows too (Unicode 13), jamo apart."""
    old = unicodedata.ucd_3_2_0
    return [chr(i) for r in (range(0x20, 0x1100), range(0x1200, 0xD7A4), range(0xF900, 0x10000), range(0x1D100, 0x1D800), range(0x2F800, 0x2FA20)) for i in r if old.category(chr(i)) not in ("Cn", "Cs")]


def test_every_character(spark):
    chars = assigned()
    texts = [f"x {c} y" for c in chars] + [f"x {unicodedata.normalize('NFD', c)} y" for c in chars if unicodedata.normalize("NFD", c) != c and not 0xAC00 <= ord(c) < 0xD7A4]
    assert len(texts) > 50_000
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", tx.fold(F.col("s")).alias("f"), tx.researcher_id(F.col("s"), F.lit("CC"), F.lit("7")).alias("r"))
    bad = [(texts[r.i], r.f, fold(texts[r.i])) for r in df.collect() if r.f != fold(texts[r.i])]
    assert not bad, bad[:10]
    bad = [(texts[r.i], r.r, rid(texts[r.i] + "_CC_7")) for r in df.collect() if r.r != rid(texts[r.i] + "_CC_7")]
    assert not bad, bad[:10]


def test_marks_in_any_mixture(spark):
    rng = random.Random(2)
    pool = list("aeinouyAENOcszÅåñÑãÁéüőšćčşğłđẫß ªº½ﬁ①_/,-") + ["̃", "́", "̂", "̈", "̊", "̧"] * 3
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["İ", "ΑΣ Σ", "ñ̃", "ẫ", "ã̂"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", tx.fold(F.col("s")).alias("f"), tx.researcher_id(F.col("s"), F.lit("x"), F.lit("1")).alias("r"))
    for r in df.collect():
        assert (r.f, r.r) == (fold(texts[r.i]), rid(texts[r.i] + "_x_1")), texts[r.i]
