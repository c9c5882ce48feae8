"""URL filtering by a bit-parallel wildcard automaton.

All glob rules are packed, one bit for each literal byte, into the words of one
Shift-And state.  Reading one byte of a URL moves every rule at once:

    S = ((S << 1 | start) & match[byte]) | (S & loop[byte])

``match`` has a rule's bit where its literal equals the byte, ``loop`` where a
wildcard follows the literal and may swallow the byte.  The state of a batch of URLs
is a matrix (URLs x words), so numpy advances all URLs of a batch by one byte in a
few operations, whatever the number of rules.

Glob syntax, over ``.host/path``: ``*`` any run of bytes other than ``/``, ``**`` any
run of bytes, ``?`` one byte other than ``/``; everything else stands for itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

_OPEN, _CLOSE, _PAD = 0x01, 0x02, 0x00
_BLOCK = 4096
_BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


class WildcardAutomaton:
    """Shift-And masks of many globs; ``first_match`` tries them in the order given."""

    def __init__(self, globs: Sequence[str]):
        literals: list[tuple[int, int]] = []  # byte (or -1 for ?), wildcard that follows (0, 1, 2)
        self.finals: list[int] = []
        for glob in globs:
            raw, i = glob.encode(), 0
            literals.append((_OPEN, 0))
            while i < len(raw):
                if raw[i] == 0x2A:
                    stars = 2 if raw[i : i + 2] == b"**" else 1
                    literals[-1] = (literals[-1][0], max(stars, literals[-1][1]))
                    i += stars
                else:
                    literals.append((-1 if raw[i] == 0x3F else raw[i], 0))
                    i += 1
            if literals[-1][1] != 2:
                literals.append((_CLOSE, 2))
            self.finals.append(len(literals) - 1)  # its loop is any byte: once set, it stays
        self.words = -(-len(literals) // 64) if literals else 1
        self.match = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for bit, (byte, stars) in enumerate(literals):
            word, mask = bit // 64, np.uint64(1 << bit % 64)
            if byte == _OPEN:
                self.start[word] |= mask
            for c in range(256):
                plain = c not in (_OPEN, _CLOSE, _PAD, 0x2F)
                if c == byte or byte == -1 and plain:
                    self.match[c, word] |= mask
                if stars == 2 or stars == 1 and plain:
                    self.loop[c, word] |= mask
        self.stay = np.zeros(self.words, np.uint64)
        for bit in self.finals:
            self.stay[bit // 64] |= np.uint64(1 << bit % 64)

    def first_match(self, urls: Sequence[bytes]) -> np.ndarray:
        """For each URL (``.host/path``) the index of the first glob that matches it whole, or -1.

        URLs of like length are read together, as many as a block of bounded bytes holds;
        a block ends as soon as no rule of any of its URLs can change any more.
        """
        out = np.full(len(urls), -1, np.int32)
        size = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            few = order[at : at + _BLOCK]
            fits = (size[few] + 2) * np.arange(1, len(few) + 1) <= _BLOCK_BYTES
            rows = few[: max(1, int(fits.sum()))]
            at += len(rows)
            wide = int(size[rows[-1]]) + 2
            text = np.frombuffer(b"".join((b"\x01" + urls[i].replace(b"\x00", b"\x03").replace(b"\x01", b"\x03").replace(b"\x02", b"\x03") + b"\x02").ljust(wide, b"\x00") for i in rows), np.uint8).reshape(len(rows), wide)
            state = np.zeros((len(rows), self.words), np.uint64)
            for t in range(wide):
                byte = text[:, t]
                moved = state << np.uint64(1)
                moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
                moved &= ~self.start
                if t == 0:
                    moved |= self.start
                state = (moved & self.match[byte]) | (state & self.loop[byte])
                if t % 64 == 63 and not (state & ~self.stay).any():
                    break
            for rule in range(len(self.finals) - 1, -1, -1):
                bit = self.finals[rule]
                hit = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
                out[rows[hit]] = rule
        return out


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(df: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule (the longest that fits, by its text; else null) and verdict.

    A null URL, or one without ``://``, has an empty host and path, no rule and the
    default verdict.  Rows are neither dropped nor merged; columns of these four names
    are replaced.  Of rules of one length the first given wins.  An empty table gives an
    empty one.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = WildcardAutomaton([r.glob for r in ranked])

    @F.pandas_udf(IntegerType())
    def rule_index(canonical: pd.Series) -> pd.Series:
        return pd.Series(automaton.first_match([u.encode("utf-8", "surrogatepass") for u in canonical]))

    names = F.array(*[F.lit(r.name) for r in ranked]) if ranked else F.array(F.lit(None).cast("string"))
    verdicts = F.array(*[F.lit(r.verdict) for r in ranked]) if ranked else names
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    out = df.withColumns({"host": host, "path": path}).withColumn("__rule", rule_index(F.concat(F.lit("."), F.col("host"), F.col("path"))))
    found = F.col("__rule") >= 0
    return out.withColumns({"rule": F.when(found, F.get(names, F.col("__rule"))), "verdict": F.when(found, F.get(verdicts, F.col("__rule"))).otherwise(F.lit(default))}).drop("__rule")
