"""Personal data against Python's matcher and a plain bootstrap."""

import collections
import hashlib
import math
import random
import re

import duckdb
import pytest

from grafita.llm import pii, registry

KINDS = ("email", "ip", "card", "phone")
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
S = r"\x20\x09-\x0D"
CANDIDATE = re.compile(rf"(?<![^{S}])[^{S}]*[0-9@][^{S}]*(?:\x20[^{S}]*[0-9@][^{S}]*)*")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(t):
    return sorted((m.start(), KINDS.index(k), m.end(), k) for k, p in PLAIN.items() for m in p.finditer(t) if holds(k, m[0]))


def fits(x):
    d = len(re.sub("[^0-9]", "", x))
    out = []
    if re.fullmatch("[^@ ]+@[^@ ]+", x):
        out.append("email")
    if re.fullmatch("[0-9a-f]*(?:[.:][0-9a-f]*){3,7}", x) and re.search("[0-9]", x):
        out.append("ip")
    if re.fullmatch("[0-9 .-]+", x) and 12 <= d <= 19:
        out.append("card")
    if re.fullmatch("[0-9 ()./+-]+", x) and 7 <= d <= 15:
        out.append("phone")
    return out


def words(t):
    return re.split(f"[{S}]+", re.sub(f"^[{S}]+|[{S}]+$", "", t.translate(LOWER)))


def brute(docs):
    bases = [base(t or "") for _, t in docs]
    occurrences, edges = [], {}
    for row, (_, t) in enumerate(docs):
        t = t or ""
        ms = list(CANDIDATE.finditer(t))
        for i, m in enumerate(ms):
            if len(m[0]) > 254:
                continue
            over = [(e, k) for s, _, e, k in bases[row] if s < m.end() and e > m.start()]
            left = words(t[ms[i - 1].end() if i else 0 : m.start()][-64:])
            right = words(t[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(t)][:64])[0]
            lead = re.match(r"[^0-9A-Za-z+(\x80-\U0010FFFF]*", m[0])[0]
            body = re.sub(r"[^0-9A-Za-z)\x80-\U0010FFFF]+$", "", m[0][len(lead) :])
            if not body:
                continue
            seed, inst = max(over)[1] if over else None, body.translate(LOWER)
            pats = [f"before {left[-2] if len(left) > 1 else ''} {left[-1]}", f"between {left[-1]} _ {right}"]
            occurrences.append((row, m.start() + len(lead), m.start() + len(lead) + len(body), inst, seed))
            for k in set(fits(inst)) | ({seed} if seed else set()):
                for p in pats:
                    edges[k, p, inst] = edges.get((k, p, inst), False) or seed == k
    scores = {}
    for _ in range(3):
        by = collections.defaultdict(list)
        for (k, p, i), known in edges.items():
            by[k, p].append(known)
        good = {kp: round(sum(v) / (len(v) + 1), 9) for kp, v in by.items() if sum(v) >= 3}
        chance = collections.defaultdict(float)
        for (k, p, i) in edges:
            if good.get((k, p), 0) >= 0.7:
                chance[k, i] += math.log(1 - good[k, p])
        scores = {ki: round(1 - math.exp(x), 9) for ki, x in chance.items() if round(1 - math.exp(x), 9) >= 0.9}
        edges = {(k, p, i): known or (k, i) in scores for (k, p, i), known in edges.items()}
    found = [[] for _ in docs]
    for row, a, b, inst, seed in occurrences:
        kinds = [k for k in fits(inst) if (k, inst) in scores]
        if seed is None and kinds:
            k = max(kinds, key=lambda k: (scores[k, inst], -KINDS.index(k)))
            found[row].append((a, KINDS.index(k), b, k))
    say = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(x))
    return sorted(((key, *[sum(s[3] == k for s in b) for k in KINDS], hashlib.sha256(say(b).encode()).hexdigest(), say(b + f), len(f)) for (key, _), b, f in zip(docs, bases, found, strict=True)), key=repr)


def cases():
    rng = random.Random(4)
    pool = ["the", "of", "señor", "日本", "😀", "call", "and", "x7", "v2.0", "3", "end."]
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    phone = lambda plus: f"{plus}{rng.randint(100, 999)} {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
    docs = []
    for i in range(40):
        docs.append(f"{say(5)} my phone: {phone('+1 ')} , {say(4)}\nhost is at 10.{i}.2.9 now {say(3)}")
    docs += [f"{say(3)} my phone: {phone('0')} , {say(2)}" for _ in range(6)] + ["host is at 10.300.2.9 now", "host is at fe80:0:1:2 now", "and 10.300.2.9 again, fe80:0:1:2."]
    docs += [f"mail me at user{i}@mail.example.com please" for i in range(9)] + ["mail me at böb@intranet please", "böb@intranet"]
    docs += ["a@b.cd%x@e.f g.h@@i.j", "x@y.z@w.v", "1.2.3.4.5.6.7.8 1.2.3 0255.1.1.1 256.1.1.1 1.2.3.400", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111" * 2, "0" * 12, "+1 (2) 3456789)) +12 +1..3", "a@b", "@", "5", "", None]
    docs += ["é4111 1111 1111 1111é 😀+1 (743) 555-3824😀", "9" * 5_000, "a" * 20_000, "a@" * 5_000, "1." * 5_000, "+1" + "(" * 10_000, "1 " * 5_000, "a.b@c.de " * 3000, "$" * 9_000 + "1"]
    return list(enumerate(docs)) + [(3, docs[3]), (None, docs[4])]


def test_finds_equal_plain_python(spark):
    docs = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 row", "'k' kind", "2 id", "3 spans")
    out = pii.find(d.repartition(5))
    got = sorted(map(tuple, out.collect()), key=repr)
    want = brute(docs)
    assert sum(x[-1] for x in want) >= 8  # contexts give something away
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found"]
    for g, w in zip(got, want, strict=True):
        assert g == w


@pytest.mark.parametrize("text", ["clean words only", "versions 1.2.3 and 4.5 of 2024-01-02, page 12345678"])
def test_clean_rows_and_empty_tables(spark, text):
    d = spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string")
    assert {(r.spans, r.n_found) for r in pii.find(d).collect()} == {("", 0)}
    assert pii.find(d.limit(0)).count() == 0


def test_very_long_runs_are_read_in_linear_time(spark):
    import time

    runs = ["9", "a", "a@", "1.", "+1(", "1 ", "a.b@c.de ", "$", "a.", "(", "@", "1-", "a1", "\n"]
    d = spark.createDataFrame([(i, x * 400_000) for i, x in enumerate(runs)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.n_email for r in pii.find(d.repartition(8)).collect()}
    assert got[6] == 400_000 and len(got) == len(runs) and time.time() - began < 120


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, "call +1 (743) 555-3824 now")], "doc_id long, text string")
    plan = pii.find(d)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sql_gives_the_same_finds(spark, tmp_path):
    docs = [(i, t) for i, t in cases()]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.OP13_SQL).fetchall()
    got = registry.queries()["op13_contextual_pii"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
