"""The queries of the corpus operators, one per operator, and the SQL for those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, decontaminate, filteraudit, fingerprints, langid, lexical, licenses, neardup, packing, pii, quality, suffixdup, toxicity
from marketlens.llm.common import documents, held_out
from marketlens.llm.packing import byte_bpe_encoder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), gpt_encoder)


def gpt_encoder():
    return byte_bpe_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    made = langid.language_id(docs, docs.filter(~held_out()))
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()))
    return toxicity.toxicity(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op2_minhash_neardup", r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents where text is not null),
s as (select doc_id, unnest(list_distinct(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end)) as g from w),
n as (select doc_id, count(*) as n from s group by 1), p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)), l as (select a, b from e union all select b, a from e),
r as (select a as doc_id, b as other from l union select r.doc_id, l.b from r join l on l.a = r.other), m as (select doc_id, min(other) as other from r group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(other, d.doc_id)) as kept from documents d left join n using (doc_id) left join m using (doc_id)""")
def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), percent=85)


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffixdup.remove_repeats(documents(spark, sf_dir), keep=["doc_id"])
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return made.select("doc_id", (F.octet_length("kept_bytes") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.find_private(documents(spark, sf_dir))
    counts = [F.size(pii.of_kind(F.col("found"), i)).cast("long").alias(f"n_{k.name}") for i, k in enumerate(pii.KINDS)]
    base = pii.span_list(F.col("found"))
    return made.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.span_list(F.col("found"), F.col("terms")).alias("spans"))


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    made = bpe.round_trip(documents(spark, sf_dir), "text", public_tokenizers.PATTERN, path, keep=["doc_id"])
    return made.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = licenses.license_scan(documents(spark, sf_dir), keep=["doc_id"])
    best = F.array_max(F.transform("notices", lambda n: F.struct(n["coverage"].alias("coverage"), n["name"].alias("name"))))
    spans = F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["name"], n["start"], n["end"])), ",")
    return made.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.coalesce(best["name"], F.lit("")).alias("license"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), spans.alias("spans"))


@query("op11_filter_audit", r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
m as (select part, coalesce(quality, 0) as good, coalesce(toxic, 0) as toxic, len(ws) < 200 as a, 100 * len(list_distinct(ws)) < 50 * len(ws) as b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d, doc_id > min(doc_id) over (partition by t) as e from d left join labels using (doc_id)),
n as (select part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) as fails, count(*) as n, sum((good = 1)::int) as good, sum((toxic = 1)::int) as toxic from m group by 1, 2),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x), o as (select concat(p.x, q.x, r.x, s.x, t.x) as filter_order from l p, l q, l r, l s, l t where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s as (select filter_order, step::int as step, filter_order[step] as f, filter_order[1:step - 1] as earlier from o, range(1, 6) g(step)),
k as (select part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) as fail, length(translate(fails, earlier, '')) < length(fails) as gone from n, s),
r as (select part, filter_order, step, f, sum(if(fail or gone, 0, n)) as kept, sum(if(fail and not gone, n, 0)) as removed, sum(if(fail and gone, n, 0)) as redundant, sum(if(fails = f, n, 0)) as unique_fails,
  sum(if(fail and not gone, good, 0)) as good_lost, sum(if(fail and not gone, toxic, 0)) as toxic_lost from k group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, f))::bigint as shapley from r""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op12_lexical_search", r"""
with t as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
n as (select doc_id, len(ws) as n from t where len(ws) > 0), s as (select count(*) as docs, sum(n)::bigint as total from n),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ws) as term from t) where term in (select term from i) group by 1, 2),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from p, s group by term, docs),
q as (select item_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::bigint as score from i join p using (term) join w using (term) join n using (doc_id), s group by 1, 2),
r as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from q where score > 0)
select item_id, rank, doc_id, score from r where rank <= 20""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


@query("op13_decontaminate", r"""
with t as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from documents),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
g as (select item_id, ws, least(10, len(ws)) as k from i where len(ws) > 0),
v as (select distinct item_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda a: array_to_string(ws[a:a + k - 1], ' '))) as run from g),
u as (select doc_id, k, unnest(range(1, len(ws) - k + 2)) as pos, ws from t, (select distinct k from v) where len(ws) >= k),
f as (select doc_id, item_id, pos, u.k as k from u join v on u.k = v.k and array_to_string(ws[pos:pos + u.k - 1], ' ') = run),
h as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(pos, pos + k)) as place from f) group by 1),
x as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from f) group by 1)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from t left join h using (doc_id) left join x using (doc_id)""")
def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return made.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
