"""Registered queries for gold sets, topic scores, judgements and summaries."""
# ruff: noqa: ANN001, ANN201, ANN202

from __future__ import annotations

from pyspark.sql import functions as F

from grafita.operators import evaluate as ev
from grafita.operators import scorers as sr
from grafita.operators import scoring as sc
from grafita.plans.derived import graph, table
from grafita.plans.registrar import registrar

QUERIES, ORACLE, reg = registrar()
AROUND = ("PARTICIPO_EN", "TIENE_TOPICO", "PERTENECE_A_AREA", "INICIO_EN", "ES_DESCRITO_POR", "TITULO_EXTRAIDO_DE")

#: Runs of a sweep out of lineitem: two parameters and a score.
RUNS = "with r as (select l_linenumber as a, l_suppkey % 4 as b, l_returnflag as k, round(avg(l_discount), 6) as f1, count(*) as n from lineitem group by 1, 2, 3) "


def runs(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("a"), (F.col("l_suppkey") % 4).alias("b"), F.col("l_returnflag").alias("k")).agg(F.round(F.avg("l_discount"), 6).alias("f1"), F.count("*").alias("n"))


@reg("e09", RUNS + "select a, b, last(f1 order by k) as f1 from r where k in ('A', 'N') group by 1, 2")
def e09(s, d):
    r = runs(s, d)
    return sc.merge_sweeps(r.where("k = 'A'").select("a", "b", "f1"), r.where("k = 'N'").select("a", "b", "f1"), ["a", "b"])


@reg("e09_report", RUNS + "select 'a' as parameter, count(distinct a) as n, count(distinct a) > 1 as varies from r where b = 0 union all select 'b', count(distinct b), count(distinct b) > 1 from r where b = 0")
def e09_report(s, d):
    return sc.parameter_report(runs(s, d).where("b = 0"), ["a", "b"])


@reg("j10", RUNS + ", m as (select a, b, f1 from r where k = 'N'), best as (select a, b from m order by f1 desc, a desc, b desc limit 1) select 'a' as parameter, cast(m.a as double) as value, f1 from m join best on m.b = best.b union all select 'b', cast(m.b as double), f1 from m join best on m.a = best.a")
def j10(s, d):
    return sc.sensitivity(runs(s, d).where("k = 'N'").select("a", "b", "f1"), ["a", "b"], None)


@reg("j01", """, o as (select id from nodes where label = 'Chunk' or (label = 'Documento' and name = 'tabla')), p as (select id from nodes where label = 'Proyecto'), e as (select distinct type, source_id, target_id from edges where type in ('PARTICIPO_EN', 'TIENE_TOPICO', 'PERTENECE_A_AREA', 'INICIO_EN', 'ES_DESCRITO_POR', 'TITULO_EXTRAIDO_DE'))
select source_id as project_id, type, source_id, target_id from e where source_id in (from p) and target_id not in (from o) union select target_id, type, source_id, target_id from e where target_id in (from p) and source_id not in (from o)""", True)
def j01(s, d):
    return sc.project_subgraphs(graph(s, d), AROUND)


@reg("j06", ", p as (select id from nodes where label = 'Proyecto') select distinct source_id as project, display as topic from edges join nodes on target_id = id and label = 'Topico' where type = 'TIENE_TOPICO' and source_id in (from p)", True)
def j06(s, d):
    return sc.gold_topics(graph(s, d))[0]


@reg("j06_titles", ", p as (select id, label, display, name from nodes where label in ('Proyecto', 'Grupo')) select id as project, case when length(id) % 3 = 0 then display when length(id) % 3 = 1 then coalesce(name, '') else '' end as title from p where not (length(id) % 3 = 1 and name is null)", True)
def j06_titles(s, d):
    """Titles out of properties, out of plain values, and out of properties that have none."""
    k = F.length("id") % 3
    props = F.when(k == 0, F.create_map(F.lit("titulo"), F.col("display"))).when(k == 2, F.create_map(F.lit("otro"), F.col("display")))
    n = graph(s, d).nodes.select("id", "label", props.alias("props"), F.when(k == 1, F.col("name")).alias("value"))
    return sc.project_titles(n)


@reg("j06_docs", ", p as (select id from nodes where label = 'Proyecto') select distinct source_id as project, target_id as doc from edges where type = 'ES_DESCRITO_POR' and source_id in (from p) and target_id not in (select id from nodes where label = 'Documento' and name = 'tabla')", True)
def j06_docs(s, d):
    return sc.gold_topics(graph(s, d))[1]


TOPICS = """with l as (select 'c' || l_linenumber % 3 as cfg, l_orderkey as project, p_name, p_type, l_returnflag, l_linestatus from lineitem join part on l_partkey = p_partkey),
p as (select distinct cfg, project, {t} as topic from l where l_returnflag <> 'R'), g as (select distinct project, {t} as topic from l where l_linestatus = 'F'),
b as (select distinct cfg, project from p where project in (select project from g)),
x as (select cfg, project, topic, max(p) as p, max(g) as g from (select cfg, project, topic, 1 as p, 0 as g from p semi join b using (cfg, project) union all select cfg, project, topic, 0, 1 from g join b using (project)) group by 1, 2, 3),
c as (select cfg, project, sum(p * g) as tp, sum(p * (1 - g)) as fp, sum(g * (1 - p)) as fn from x group by 1, 2),
s as (select *, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as pr, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as re, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f from c)
select cfg, count(*) as projects, round(avg(pr), 4) as macro_precision, round(avg(re), 4) as macro_recall, round(avg(f), 4) as macro_f1, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn,
round(sum(tp) / (sum(tp) + sum(fp)), 4) as micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 4) as micro_recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) as micro_f1 from s group by cfg"""


def topics(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pred = li.where("l_returnflag <> 'R'").select(F.concat(F.lit("c"), (F.col("l_linenumber") % 3).cast("string")).alias("cfg"), F.col("l_orderkey").alias("project"), F.col("p_name").alias("topic"))
    return pred.distinct(), li.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("project"), F.col("p_name").alias("topic")).distinct()


@reg("j07", TOPICS.format(t="p_name"))
def j07(s, d):
    return sc.score_topics(*topics(s, d))


@reg("j08", TOPICS.format(t="(case when p_name like 'c%' then p_name else left(p_name, 1) end)"))
def j08(s, d):
    names = table(s, d, "part").where("p_name not like 'c%'").select(F.col("p_name").alias("topic"), F.substring("p_name", 1, 1).alias("subfield")).distinct()
    return sc.score_subfields(*topics(s, d), names)


@reg("j05", "with a as (select n_name as model, round(avg(c_acctbal), 4) as f1 from customer join nation on c_nationkey = n_nationkey group by 1), b as (select n_name as model, count(*) as score from supplier join nation on s_nationkey = n_nationkey group by 1) select coalesce(a.model, b.model) as model, f1, score from a full join b on a.model = b.model")
def j05(s, d):
    n = table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("model"))
    a = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("model").agg(F.round(F.avg("c_acctbal"), 4).alias("f1"))
    b = table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("model").agg(F.count("*").alias("score"))
    return sc.leaderboard(a, b)


EV = "with e as (select event_id, user_id % 3 as m, event_type, cast(json_extract(props, '$.k') as bigint) as k from events) "


def judged(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(s, d, "events").select("event_id", (F.col("user_id") % 3).alias("m"), "event_type", k.alias("k"))


@reg("j11", EV + """, j as (select event_id, event_type not in ('error', 'signup') as valid, k % 5 as tp, k % 3 as fp, k % 4 as fn from e)
select event_id, valid, case when valid then round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 4) end as precision, case when valid then round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 4) end as recall, case when valid then round(case when tp = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 4) end as f1 from j""")
def j11(s, d):
    some = lambda n: F.array_repeat(F.lit("a, \"b\""), n)
    body = F.to_json(F.struct(some(F.col("k") % 5).alias("matched"), some(F.col("k") % 4).alias("missing"), some(F.col("k") % 3).alias("extra")))
    # errors have a key too many, sign-ups a blank member
    text = F.when(F.col("event_type") == "error", F.to_json(F.struct(some(F.lit(1)).alias("matched"), some(F.lit(1)).alias("missing"), some(F.lit(1)).alias("extra"), F.lit(1).alias("more"))))
    text = text.when(F.col("event_type") == "signup", F.lit('{"matched": [" "], "missing": [], "extra": []}')).otherwise(F.concat(F.lit("Sure:\n"), body))
    return sc.score_judgements(judged(s, d).withColumn("judge", text)).select("event_id", "valid", "precision", "recall", "f1")


@reg("j12", EV + "select event_id, event_type in ('error', 'click') as sentinel, case when event_type in ('error', 'click') then k % 2 = 0 end as is_right from e")
def j12(s, d):
    gold = F.when(F.col("event_type") == "error", sc.SENTINELS[0].upper()).when(F.col("event_type") == "click", "  ").otherwise("algo")
    t = judged(s, d).withColumn("gold", gold)
    t = t.withColumn("said", F.when(F.col("k") % 2 == 0, F.concat(F.lit(" "), F.replace("gold", F.lit(" "), F.lit("\n ")))).otherwise("nada"))
    return sc.score_sentinels(t, ["gold"], "said").select("event_id", "sentinel", F.col("right").alias("is_right"))


SUMMARY = EV + """, r as (select m, event_type = 'error' as sentinel, k % 2 = 0 and k % 5 <> 0 as is_right, case when event_type <> 'error' then 1 + k % 5 end as x, case when event_type <> 'error' then 1 + k % 4 end as y, case when event_type <> 'error' then 1 + k % 3 end as z, k % 5 = 0 as qe, k % 7 = 0 as je from e),
q as (select *, (round((x + y + z) / 3, 4) - 1) / 4 as q, case when sentinel then {hit} end as hit from r)
select m, count(x) as n_judged, count(*) filter (sentinel) as n_sentinel, round(avg((x - 1) / 4), 4) as x, round(avg((y - 1) / 4), 4) as y, round(avg((z - 1) / 4), 4) as z, round(avg(q), 4) as quality, round(avg(hit), 4) as sentinel_accuracy, round(avg(coalesce(hit, q)), 4) as overall{more} from q group by m"""


def scored(s, d):
    k, plain = F.col("k"), F.col("event_type") != "error"
    r = judged(s, d).withColumns({"sentinel": ~plain, "right": F.when(~plain, k % 2 == 0), "query_error": F.when(k % 5 == 0, "E"), "judge_error": F.when(k % 7 == 0, "J").otherwise("")})
    return r.withColumns({"x": F.when(plain, 1 + k % 5), "y": F.when(plain, 1 + k % 4), "z": F.when(plain, 1 + k % 3)})


@reg("j14", SUMMARY.format(hit="(k2)::int", more="").replace("k % 5 = 0 as qe", "k % 5 = 0 as qe, k % 2 = 0 as k2"))
def j14(s, d):
    return sc.generation_summary(scored(s, d), ["m"], ["x", "y", "z"])


@reg("j15", SUMMARY.format(hit="is_right::int", more=", count(*) filter (qe) as query_errors, count(*) filter (je) as judge_errors"))
def j15(s, d):
    return sc.e2e_summary(scored(s, d), ["m"], ["x", "y", "z"])


@reg("j17_j18", "with r as (select user_id % 5 as combo, round(avg(value), 2) as q from events group by 1) select combo, q, round(least(0.95, greatest(0, floor((min(q / 1000) over () - 0.03) / 0.05) * 0.05)), 2) as floor from (select combo, q from r)")
def j17_j18(s, d):
    r = table(s, d, "events").groupBy((F.col("user_id") % 5).alias("combo")).agg(F.round(F.avg("value"), 2).alias("q")).withColumn("u", F.col("q") / 1000)
    return ev.best_combo(r, "combo", "u").select("combo", F.round(F.col("u") * 1000, 2).alias("q"), "floor")


E01 = """with t as (select doc_id, text, lower(text) as low from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
z as (select doc_id, contains(text, '@') as bad, [struct_pack(topic := 'artikel', z := (length(low) - length(replace(low, ' der ', ''))) / 5), struct_pack(topic := 'article', z := (length(low) - length(replace(low, ' the ', ''))) / 5),
  struct_pack(topic := 'artículo', z := (length(low) - length(replace(low, ' los ', ''))) / 5), struct_pack(topic := 'none', z := 1.0)] as zs from t),
e as (select doc_id, unnest(zs) as s from z where not bad), p as (select doc_id, s.topic as topic, s.z as logit, exp(s.z - max(s.z) over (partition by doc_id)) as x from e),
q as (select doc_id, topic, logit, x / sum(x) over (partition by doc_id) as prob from p)
select doc_id, topic, round(prob, 6) as prob, logit::double as logit, row_number() over (partition by doc_id order by prob desc, topic) as rank, null as error from q where prob >= 0.08
union all select doc_id, null, null, null, null, 'BertExtractionError: RuntimeError: can''t take @' from z where bad"""


@reg("e01", E01)
def e01(s, d):
    """Documents scored by their articles; one with an @ makes its batch raise, and only its own row fails."""
    words = {"artikel": [" der "], "article": [" the "], "artículo": [" los "]}

    def factory():
        from math import exp

        count = sr.keyword_scorer(words, "@")()

        def score(batch):
            out = []
            for scores in count(batch):
                z = {t: v for t, _, v in scores} | {"none": 1.0}
                top = max(z.values())
                total = sum(exp(v - top) for v in z.values())
                out.append([(t, exp(v - top) / total, v) for t, v in z.items()])
            return out

        return score

    c = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return sr.score_chunks(c, "articles", factory).select(F.col("chunk_id").alias("doc_id"), "topic", F.round("prob", 6).alias("prob"), "logit", F.col("rank").cast("long").alias("rank"), "error")
