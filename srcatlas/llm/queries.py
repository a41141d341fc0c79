"""The operators bound to the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, langid, media, middles, neardup, packing, pii, secrets, sharding, substrings, toxicity, urls
from .common import fold, materialise, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "neighbours", "similarities")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), forest)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "representative", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents")).withColumn("tile_npy", F.sha2("tile_npy", 256)).withColumnRenamed("tile_npy", "tile_sha256")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(pii.candidates(table(spark, sf_dir, "documents")), "pii")
    return pii.decide(found, pii.fit(found)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.listed_rules(spark))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middles.fill_in_middle(table(spark, sf_dir, "documents"))
    back = middles.restored(F.col("output"), F.col("form"))
    digests = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_secret_scan": op3_secret_scan,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language_id": op5_language_id,
    "op6_media_columns": op6_media_columns,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sharding": op8_sharding,
    "op9_personal_data": op9_personal_data,
    "op10_decontamination": op10_decontamination,
    "op11_url_filters": op11_url_filters,
    "op12_source_divergence": op12_source_divergence,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: Words between ASCII white space, windows of 50, and the smallest id that holds each.
_REPEATS = r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
p as (select doc_id, words, unnest(range(1, len(words) + 1)) as pos from w),
s as (select doc_id, pos, words[pos] as word, case when pos + 49 <= len(words) then array_to_string(words[pos : pos + 49], ' ') end as win from p),
o as (select win, min(doc_id) as owner from s where win is not null group by win),
f as (select s.doc_id, s.pos, s.word, coalesce(o.owner < s.doc_id, false) as hit from s left join o on o.win = s.win),
c as (select doc_id, pos, word, bool_or(hit) over (partition by doc_id order by pos rows between 49 preceding and current row) as gone from f),
k as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by pos) filter (where not gone) as kept from c group by doc_id)
select w.doc_id, coalesce(k.n_words, 0) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from w left join k using (doc_id)"""

#: All pairs that share a shingle, their weighted Jaccard similarity, and the smallest id reachable by links.
_CLASSES = r"""with recursive t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
g as (select doc_id, case when len(words) between 1 and 4 then [array_to_string(words, ' ')] when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i : array_to_string(words[i : i + 4], ' ')) else [] end as grams from t),
s as (select doc_id, gram, 1 + ln(count(*)) as tf from (select doc_id, unnest(grams) as gram from g) group by doc_id, gram),
n as (select count(*) as n from documents),
d as (select gram, 1 + log10(1 + n.n / greatest(count(*), 0.01 * n.n)) as idf, count(*) as df from s, n group by gram, n.n),
v as (select s.doc_id, s.gram, s.tf * d.idf as w, d.df from s join d using (gram)),
total as (select doc_id, sum(w) as w from v group by doc_id),
pairs as (select x.doc_id as a, y.doc_id as b, sum(least(x.w, y.w)) as shared from v x join v y on x.gram = y.gram and x.doc_id < y.doc_id where x.df > 1 group by x.doc_id, y.doc_id),
links as (select a, b from pairs join total ta on ta.doc_id = a join total tb on tb.doc_id = b where shared / (ta.w + tb.w - shared) >= 0.8
union select (select min(doc_id) from g where len(grams) = 0), doc_id from g where len(grams) = 0),
edges as (select a, b from links union select b, a from links),
reach as (select doc_id as node, doc_id as root from documents union select e.b, r.root from reach r join edges e on e.a = r.node where r.root < e.b),
class as (select node, min(root) as class_id from reach group by node),
reps as (select md5(coalesce(text, '')) as m, min(doc_id) as representative from documents group by all)
select d.doc_id, c.class_id, r.representative, d.doc_id = c.class_id as kept from documents d join class c on c.node = d.doc_id join reps r on r.m = md5(coalesce(d.text, ''))"""

#: Host and path of each url, every rule tested on it, the longest that fits.
_URLS = r"""with r as (select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, r_host, r_path)),
u as (select page_id, row_number() over () as id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, id, regexp_extract(rest, '^[^/?#]*') as raw, rest from u),
p as (select page_id, id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
b as (select p.id, max_by(r, length(r_host || r_path)) as r from p join r on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path) group by p.id)
select page_id, host, path, b.r.r_host || b.r.r_path as rule, coalesce(b.r.verdict, 'allow') as verdict from p left join b using (id)"""

#: Every kept term of every pair of groups, one by one.
_DIVERGENCE = r"""with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
w as (select id, lang, source, unnest(terms) as term from d),
kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct id) >= 10),
v as (select lang, count(*) as v, sum(n) as total from kept group by lang),
g as (select distinct lang, source from d),
c as (select w.lang, w.source, w.term, count(*) as n from w join kept using (lang, term) group by all),
t as (select lang, source, sum(n) as total from c group by all),
s as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n,
  1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.v) as p,
  1 + (1000000000::hugeint * (kept.n + 2)) // (v.total + 2 * v.v) as q
  from g join kept using (lang) join v using (lang) left join t using (lang, source) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
f as (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value from s x join s y on x.lang = y.lang and x.term = y.term and x.source != y.source group by all),
pairs as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(f.value, 0)::bigint as value from g x join g y on x.lang = y.lang and x.source != y.source left join f on f.lang = x.lang and f.source = x.source and f.item = y.source),
best as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from s where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from best))
select * from ranked where part = 'pair' or rank <= 10"""

#: Units, draws and pieces by lists; the way back is the pieces in their first order.
_MIDDLES = r"""with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
k as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select doc_id, text, n, form, array_to_string(units[1:a], '') as pre, array_to_string(units[a + 1:b], '') as mid, array_to_string(units[b + 1:n], '') as suf from k)
select doc_id, n::bigint as n, form, case when form != 'plain' then length(pre)::bigint end as prefix_chars, case when form != 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(case form when 'plain' then text else pre || mid || suf end) as restored_sha256 from p"""

ORACLE: dict[str, str] = {
    "op4_near_duplicates": _CLASSES,
    "op7_substring_dedup": _REPEATS,
    "op11_url_filters": _URLS,
    "op12_source_divergence": _DIVERGENCE,
    "op13_fill_in_middle": _MIDDLES,
}
