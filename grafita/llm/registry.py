"""The registered queries of the subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafita.llm.common import table

#: The fixed rules of the URL query: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.ann import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.substring_dedup import remove_repeats

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(documents, window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.toxicity import fit_from_tables, score

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_from_tables(documents, table(spark, sf_dir, "labels"))
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    return score(documents, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.html_text import extract, fit_from_table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit_from_table(pages))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.url_filter import Rule, filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, [Rule(*r) for r in URL_RULES]).select("page_id", "host", "path", "rule", "verdict")


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.packing import pack, tokenize_pieces

    return pack(tokenize_pieces(table(spark, sf_dir, "documents"), vocabulary(), 1024), 1024)


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.mixing import mix

    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(documents).select("doc_id", "source", "mix_round", "mix_block", "mix_at", "mix_tokens")


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8)


def op11_prefix_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=10, min_words=20)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=8)


def op13_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grafita.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(rest, '^[^?#]*') as whole from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(whole, length(raw) + 1) as path from h),
rules(verdict, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (select page_id, rhost || rpath as rule, verdict, row_number() over (partition by page_id order by length(rhost || rpath) desc) as n
      from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') as verdict
from p left join m on p.page_id = m.page_id and m.n = 1
"""

OP11_SQL = r"""
with bits as (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i)),
step as (select list(c order by i) as t from bits),
texts as (select 's' as side, row_number() over () as r, doc_id, text from documents union all select 't', row_number() over (), null, text from benchmark),
found as (select side, r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from texts),
each as (select side, r, w, count(*) as k from (select side, r, unnest(ws) as w from found) group by all),
vocabulary as (select w, hex(encode(w)) as x from (select distinct w from each)),
crc as (select w, xor(list_reduce([4294967295]::bigint[] || list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from vocabulary, step),
held as (select side, r, bucket, k from each join crc using (w)),
buckets as (select bucket, coalesce(sum(k) filter (side = 's'), 0)::double as s, coalesce(sum(k) filter (side = 't'), 0)::double as t from held group by 1),
whole as (select coalesce(sum(s), 0)::double as S_, coalesce(sum(t), 0)::double as T_ from buckets),
gains as (select bucket, floor(1000 * ln(((t + 1) * (S_ + 10000)) / ((s + 1) * (T_ + 10000))))::bigint as gain from buckets, whole),
means as (select r, sum(k * gain) as total, sum(k) as n from held join gains using (bucket) where side = 's' group by 1),
scored as (select r, doc_id, len(ws) as n_features, case when n is null then 0 else floor(total::double / n)::bigint end as weight,
           ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from found left join means using (r) where side = 's'),
final as (select r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from scored),
drawn as (select r, row_number() over (order by score desc, doc_id nulls last, n_features, weight) as rank, count(*) over () as n from final where n_features >= 20)
select doc_id, n_features::bigint as n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from final left join drawn using (r)
"""

_ROUND = """
good{n} as (select pattern, round(count(*) filter (known) / (count(*) + 1), 9) as s from edges{m} group by 1 having count(*) filter (known) >= 3 and round(count(*) filter (known) / (count(*) + 1), 9) >= 0.7),
scores{n} as (select instance, round(1 - exp(sum(ln(1 - s))), 9) as score from edges{m} join good{n} using (pattern) group by 1 having round(1 - exp(sum(ln(1 - s))), 9) >= 0.9),
edges{n} as (select pattern, instance, known or score is not null as known from edges{m} left join scores{n} using (instance)),
"""
_LUHN = "list_sum(list_transform(range(length(g)), lambda i: case when i % 2 = 0 then substr(g, length(g) - i, 1)::int else (substr(g, length(g) - i, 1)::int * 2) // 10 + (substr(g, length(g) - i, 1)::int * 2) % 10 end)) % 10 = 0"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"string_split_regex(regexp_replace(" + _LOW + r", '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+')"
_FITS = r"""list_filter([case when seed = 'email' or regexp_matches(instance, '^[^@ ]+@[^@ ]+$') then 'email' end,
    case when seed = 'ip' or (regexp_matches(instance, '^[0-9a-f]*(?:[.:][0-9a-f]*){3,7}$') and regexp_matches(instance, '[0-9]')) then 'ip' end,
    case when seed = 'card' or (regexp_matches(instance, '^[0-9 .-]+$') and length(regexp_replace(instance, '[^0-9]', '', 'g')) between 12 and 19) then 'card' end,
    case when seed = 'phone' or (regexp_matches(instance, '^[0-9 ()./+-]+$') and length(regexp_replace(instance, '[^0-9]', '', 'g')) between 7 and 15) then 'phone' end], lambda k: k is not null)"""

OP13_SQL = (
    r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
cut as (
  select r, 'email' as kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as f, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') as s from d
  union all select r, 'ip', regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') from d
  union all select r, 'card', regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), string_split_regex(t, '[0-9](?:[\x20-]?[0-9])+') from d
  union all select r, 'phone', regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') from d
  union all select r, 'candidate', regexp_extract_all(t, '[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*(?:\x20[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*)*'),
         string_split_regex(t, '[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*(?:\x20[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*)*') from d),
each as (select r, kind, generate_subscripts(s, 1) as i, unnest(s) as piece, unnest(list_append(f, null)) as found from cut where len(f) > 0),
placed as (select *, sum(length(piece) + coalesce(length(found), 0)) over w as e, lead(left(piece, 64)) over w as after, regexp_replace(found, '[^0-9]', '', 'g') as g from each window w as (partition by r, kind order by i)),
spans as (select r, kind, e - length(found) as b, e, found, right(piece, 64) as tail, after from placed where found is not null and case kind when 'email' then true
  when 'ip' then len(list_filter(string_split(found, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(ltrim(x, '0') as int), 0) > 255)) = 0
  when 'card' then length(g) between 12 and 19 and """
    + _LUHN
    + r""" when 'phone' then length(g) between 9 and 15 else length(found) <= 254 end),
base as (select * from spans where kind <> 'candidate'),
seeds as (select c.r, c.b, max_by(s.kind, (s.e, s.kind)) as seed from spans c join base s on c.r = s.r and s.b < c.e and s.e > c.b where c.kind = 'candidate' group by all),
trimmed as (select r, b, seed, tail, after, regexp_extract(found, '^[^0-9A-Za-z+(\x{80}-\x{10FFFF}]*') as lead, found from spans left join seeds using (r, b) where kind = 'candidate'),
bodies as (select *, regexp_replace(substr(found, length(lead) + 1), '[^0-9A-Za-z)\x{80}-\x{10FFFF}]+$', '') as body from trimmed),
candidates as (select r, b + length(lead) as b, b + length(lead) + length(body) as e, seed, """
    + _LOW.format("body")
    + " as instance, "
    + _WORDS.format("tail")
    + " as lw, "
    + _WORDS.format("after")
    + r"""[1] as rw from bodies where body <> ''),
wide as (select instance, seed, unnest(['before ' || coalesce(case when len(lw) > 1 then lw[-2] end, '') || ' ' || lw[-1], 'between ' || lw[-1] || ' _ ' || rw]) as pattern, """
    + _FITS
    + r""" as kinds from candidates),
kinded as (select instance, seed, pattern, unnest(kinds) as kind from wide),
edges0 as (select kind || ' ' || pattern as pattern, kind || ' ' || instance as instance, bool_or(coalesce(seed = kind, false)) as known from kinded group by 1, 2),
"""
    + "".join(_ROUND.format(n=n, m=n - 1) for n in (1, 2, 3))
    + r"""open as (select r, b, e, instance, unnest("""
    + _FITS.replace("seed = 'email' or ", "").replace("seed = 'ip' or ", "").replace("seed = 'card' or ", "").replace("seed = 'phone' or ", "")
    + r""") as kind from candidates where seed is null),
hit as (select r, b, e, max_by(kind, (score, kind = 'email', kind = 'ip', kind = 'card', kind = 'phone')) as kind from open join scores3 on scores3.instance = kind || ' ' || open.instance group by r, b, e),
every as (select r, kind, b, e, true as base from base union all select r, kind, b, e, false from hit),
said as (select r, count(*) filter (base and kind = 'email') as n_email, count(*) filter (base and kind = 'ip') as n_ip, count(*) filter (base and kind = 'card') as n_card, count(*) filter (base and kind = 'phone') as n_phone,
  count(*) filter (not base) as n_found, string_agg(kind || ':' || b || ':' || e, ',' order by b, list_position(['email', 'ip', 'card', 'phone'], kind)) as spans,
  string_agg(kind || ':' || b || ':' || e, ',' order by b, list_position(['email', 'ip', 'card', 'phone'], kind)) filter (base) as bases from every group by r)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(bases, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_found, 0) as n_found from d left join said using (r)
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_multiprobe_ann, op2_substring_dedup, op3_warc, op4_toxicity, op5_embedding_dedup, op6_html_text, op7_url_filter,
        op8_sum_of_squares_packing, op9_temperature_mixing, op10_bag_minhash, op11_prefix_crc_resampling, op12_embedding_whitening, op13_contextual_pii,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL, "op11_prefix_crc_resampling": OP11_SQL, "op13_contextual_pii": OP13_SQL}
