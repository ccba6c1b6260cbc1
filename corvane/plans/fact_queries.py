"""Queries over facets, paths, facts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import belief, facets, relations, retrieve, vectors
from corvane.plans.tables import BM25, FACETS, QRY, VOC, benchmark_queries, doc_arrays, order_paths, table, texts, top_sql
from corvane.plans.corpus_queries import _SIG
from corvane.plans.ranking_queries import ASKED, _literal, _literal_sql
from corvane.session import checkpointed, join_checked


def count_filtered(spark, d):
    return facets.count(order_paths(spark, d), contains="/FRANCE/", kind="pdf", date="199")


def count_by_month(spark, d):
    return facets.by_month(order_paths(spark, d))


def types_available(spark, d):
    return facets.types(order_paths(spark, d))


def undated_gap(spark, d):
    return facets.count(order_paths(spark, d))


def most_recent_k(spark, d):
    """The five latest pdfs."""
    return facets.latest(order_paths(spark, d), 5, kind="pdf")


def ref_join(spark, d):
    """The orders of every customer in debt, the latest first."""
    codes = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("ref"))
    return facets.holders(order_paths(spark, d), codes)


def _doc_facets(spark, d, hits=None):
    """Facets of documents, or of those among the hits: the type by source, a date from n_chars, and the codes of the text."""
    docs = table(spark, d, "documents")
    if hits is not None:  # before the codes are sought
        docs = join_checked(docs, hits.select("doc_id").distinct(), "doc_id", "left_semi", row_bytes=64)
    day = F.lpad((F.col("n_chars") % 28 + 1).cast("string"), 2, "0")
    return docs.select("doc_id", F.col("source").alias("type"), F.when(F.col("n_chars") % 10 == 0, T.NO_DATE).otherwise(F.concat(F.lit("2024-01-"), day)).alias("date"), T.codes(F.col("text")).alias("refs"))


def recency_blend(spark, d):
    """The ten best of a pool of 50, a third by their date."""
    pool = facets.pool_size(10, False, True, False)
    return facets.apply(retrieve.bm25_topk(doc_arrays(spark, d), _literal(spark, ASKED), pool), _doc_facets(spark, d), 10, recency=0.3)


def exact_ref_boost(spark, d):
    """A pool of 400 with the holders of the most frequent code first."""
    pool = facets.pool_size(10, False, False, True)
    refs = texts(spark, d).select(F.explode(T.codes(F.col("text"))).alias("ref"))
    top = refs.groupBy("ref").count().orderBy(F.desc("count"), "ref").first()
    hits = checkpointed(retrieve.bm25_topk(doc_arrays(spark, d), _literal(spark, ASKED), pool))
    return facets.apply(hits, _doc_facets(spark, d, hits), 10, codes=[top[0]] if top else [])


def empty_filter_report(spark, d):
    """For each benchmark query without a document of source src0 among the best ten: what there is instead."""
    hits = retrieve.bm25_topk(doc_arrays(spark, d), benchmark_queries(spark, d), 10)
    out = facets.empty_filter_report(hits, _doc_facets(spark, d), "src0")
    return out.select("qid", "n", "first_doc", F.array_join(F.transform("types", lambda t: F.concat_ws(":", t["type"], t["n"].cast("string"))), " ").alias("types"))


def path_entities(spark, d):
    return relations.path_edges(order_paths(spark, d)).select("doc_id", "role", "entity")


def related_entity(spark, d):
    """For every folder the ten documents that it says most about."""
    edges = relations.path_edges(order_paths(spark, d))
    return relations.related(edges, edges.where("role = 'folder'").select("entity").distinct())


def multi_hop(spark, d):
    """From every document to its entities and on to ten others with each."""
    paths = order_paths(spark, d)
    return relations.siblings(relations.path_edges(paths), paths.select("doc_id"))


def bind_unbind(spark, d):
    """Entities read back from the bound vectors of their documents."""
    edges = relations.path_edges(order_paths(spark, d))
    out = vectors.unbind(vectors.bind(edges), edges.select("role", "entity"))
    return out.select("doc_id", "role", "entity", F.round("score", 6).alias("score"))


def _facts(spark, d, by_day=False):
    t = F.date_trunc("day", "ts") if by_day else F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"), F.lit("last_event").alias("attribute"), F.col("event_type").alias("value"), t.cast("double").alias("t"))


def belief_latest(spark, d):
    """The value at the last day of each user, and the candidates where there are several."""
    return belief.latest(_facts(spark, d, True)).select("entity", "attribute", "value", F.array_join("candidates", " ").alias("candidates"), "t")


def belief_current(spark, d):
    c = belief.current(_facts(spark, d, True))
    return c.withColumn("candidates", F.array_join("candidates", " "))


def belief_history(spark, d):
    return belief.history(_facts(spark, d))


def belief_recency_weight(spark, d):
    return belief.weights(_facts(spark, d, True)).select("entity", "attribute", "value", "n", "age", F.round("w", 6).alias("w"))


def belief_calibration(spark, d):
    return belief.calibrate(_facts(spark, d))


def belief_resolve(spark, d):
    """Contested beliefs settled by the values of events as evidence, and two slots of which nothing is known."""
    facts = _facts(spark, d, True)
    proof = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"), F.lit("last_event").alias("attribute"), F.col("event_type").alias("value"), F.round("value", 4).alias("score")).where("score is not null")
    none = spark.createDataFrame([("nobody", "last_event"), ("u1", "colour")], "entity string, attribute string")
    return belief.resolve(belief.current(facts), proof, asked=facts.select("entity", "attribute").unionByName(none))


def html_to_text(spark, d):
    """Pages without scripts, styles, comments and tags."""
    bare = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]+>", " ")
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " ")).alias("text"))


QUERIES = {f.__name__: f for f in (count_filtered, count_by_month, types_available, undated_gap, most_recent_k, ref_join, recency_blend, exact_ref_boost, path_entities, related_entity, multi_hop, bind_unbind, belief_latest, belief_current, belief_history, belief_recency_weight, belief_calibration, belief_resolve, empty_filter_report, html_to_text)}

_BARE = "regexp_replace(t, '[^0-9A-Za-z]', '', 'g')"
_CODES = f"list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '{T.CODE}'), lambda t: (length({_BARE}) >= 5 and regexp_matches({_BARE}, '[A-Za-z]') and regexp_matches({_BARE}, '[0-9]')) or (length({_BARE}) >= 6 and regexp_matches({_BARE}, '^[0-9]+$'))), lambda t: upper({_BARE}))"
_DF = f"""df as (select doc_id, source as type, case when n_chars % 10 = 0 then '{T.NO_DATE}' else '2024-01-' || lpad((n_chars % 28 + 1)::varchar, 2, '0') end as date, list_distinct({_CODES}) as refs from documents)"""


def _apply(pool: int, recency: float, exact: str) -> str:
    return f"""with {VOC}, {_literal_sql(ASKED)}, {BM25}, {_DF},
p as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as r from bm qualify r <= {pool}),
top as (select ref from (select unnest(refs) as ref from df) group by 1 order by count(*) desc, ref limit 1),
h as (select qid, doc_id, r, score, type, date, {exact} as exact from p join df using (doc_id)),
s as (select *, row_number() over (partition by qid, exact order by r) as s, row_number() over (partition by qid, exact order by date desc, r) as d from h),
v as (select *, case when exact then 1.0::double / (60 + s) else (1 - {recency}::double) / (60 + s) + {recency}::double / (60 + d) end as v from s)
select qid, doc_id, k::int as rank, round(round(score, 6), 6) as score, type, date, exact from (select *, row_number() over (partition by qid order by exact desc, round(v, 12) desc, r) as k from v) where k <= 10"""


_EDGES = rf"""seg as (select doc_id, unnest(list_slice(string_split(lower(doc_id), '/'), 1, -2)) as s, unnest(range(1, len(string_split(doc_id, '/')))) as pos from facets),
yr as (select *, last_value(case when regexp_matches(s, '{relations.YEAR}') then s when regexp_matches(s, '{relations.MONTH_YEAR}') then regexp_extract(s, '{relations.MONTH_YEAR}', 2) end ignore nulls) over (partition by doc_id order by pos) as y from seg),
e0 as (select doc_id, 'year' as role, s as entity from yr where regexp_matches(s, '{relations.YEAR}')
  union all select doc_id, 'month', regexp_extract(s, '{relations.MONTH_YEAR}', 2) || '-' || regexp_extract(s, '{relations.MONTH_YEAR}', 1) from yr where regexp_matches(s, '{relations.MONTH_YEAR}')
  union all select doc_id, 'folder', array_to_string(regexp_extract_all(regexp_replace(s, '{relations.ORDER_PREFIX}', ''), '{T.TOKEN}'), '_') from yr where not regexp_matches(s, '{relations.YEAR}') and not regexp_matches(s, '{relations.MONTH_YEAR}')
  union all select doc_id, 'month', y || '-' || regexp_extract(s, '{relations.MONTH_LABEL}', 1) from yr where y is not null and regexp_matches(s, '{relations.MONTH_LABEL}')),
edges as (select distinct * from e0 where entity <> '')"""
_FACT = "facts as (select 'u' || user_id as entity, 'last_event' as attribute, event_type as value, {} as t from events)"
_DAY, _TS = _FACT.format("epoch(date_trunc('day', ts))::double"), _FACT.format("epoch(ts)::double")
_BIT = "(('0x' || substr(sha256('V:' || attribute || ':' || value || '#' || (i // 64)), ((i % 64) + 1)::int, 1))::int)"
#: sims(entity, attribute, candidate, sim): 1,024 signs a value, compared digit by digit of the hashes
_MARGIN = f"""wt as (select entity, attribute, value, sum(power(0.6::double, age)) as w from (select *, dense_rank() over (partition by entity, attribute order by t desc) - 1 as age from facts) group by all),
vals as (select distinct attribute, value from facts), bits as (select attribute, value, unnest(range(256)) as i from vals), hex as (select attribute, value, i, {_BIT} as x from bits),
dots as (select a.attribute, a.value as candidate, b.value, 1 - 2 * sum(bit_count(xor(a.x, b.x)))::double / 1024 as dot from hex a join hex b on a.attribute = b.attribute and a.i = b.i group by all),
sims as (select entity, attribute, candidate, sum(w * dot) as sim from wt join dots using (attribute, value) group by all),
tops as (select *, row_number() over (partition by entity, attribute order by round(sim, 9) desc, candidate) as r from sims qualify r <= 2),
marg as (select entity, attribute, max(candidate) filter (r = 1) as nearest, max(candidate) filter (r = 2) as second, max(sim) filter (r = 1) - coalesce(max(sim) filter (r = 2), 0) as margin from tops group by all),
lat as (select entity, attribute, list_sort(list(distinct value)) as candidates, max(t) as t from (select *, max(t) over (partition by entity, attribute) as m from facts) where t = m group by all)"""

_ROLES = ", ".join(f"('{r}', {vectors.role_shift(r)})" for r in ("folder", "month", "year"))
#: ub(doc_id, role, entity, score): all known entities against all documents' bound vectors
_BOUND = f"""words as (select distinct entity as token from edges), {_SIG}, turn(role, shift) as (values {_ROLES}),
mark as (select role, entity, (place + shift) % {vectors.DIM} as idx, case when r <= 20 then 1 else -1 end as s from (select distinct role, entity from edges) join turn using (role) join sig on token = entity),
cell as (select doc_id, idx, sum(s)::bigint as v from edges join mark using (role, entity) group by all), peak as (select doc_id, max(abs(v)) as peak from cell group by 1),
bq as (select doc_id, idx, round_even(v * 127.0::double / peak, 0)::int as q from cell join peak using (doc_id)), bn as (select doc_id, sqrt(sum(q * q)) as n from bq group by 1),
ub as (select doc_id, role, entity, sum(q * s) / (any_value(n) * sqrt(40)) as score from bq join mark using (idx) join bn using (doc_id) group by all)"""

SQL = {
    "count_filtered": f"with {FACETS} select count(*) as n, count(*) filter (date = '0000-00-00') as undated from facets where contains(lower(doc_id), '/france/') and type = 'pdf' and date like '199%'",
    "count_by_month": f"with {FACETS} select substr(date, 1, 7) as month, count(*) as n from facets where date <> '0000-00-00' group by 1",
    "types_available": f"with {FACETS} select type, count(*) as n from facets group by 1",
    "undated_gap": f"with {FACETS} select count(*) as n, count(*) filter (date = '0000-00-00') as undated from facets",
    "most_recent_k": f"with {FACETS} select doc_id, type, date from facets where type = 'pdf' and date <> '0000-00-00' order by date desc, doc_id limit 5",
    "ref_join": f"with {FACETS} select ref, doc_id, type, date, row_number() over (partition by ref order by date desc, doc_id)::int as place from facets join (select 'C' || lpad(c_custkey::varchar, 7, '0') as ref from customer where c_acctbal < 0) using (ref)",
    "recency_blend": _apply(50, 0.3, "false"),
    "exact_ref_boost": _apply(400, 0.0, "coalesce(list_contains(refs, (select ref from top)), false)"),
    "path_entities": f"with {FACETS}, {_EDGES} select * from edges",
    "related_entity": f"""with {FACETS}, {_EDGES}, h as (select doc_id, count(*) as held from edges group by 1),
s as (select entity, doc_id, round(count(*) / sqrt(any_value(held)), 6) as score from edges join h using (doc_id) where entity in (select entity from edges where role = 'folder') group by all)
select entity, doc_id, r::int as rank, score from (select *, row_number() over (partition by entity order by score desc, doc_id) as r from s) where r <= 10""",
    "multi_hop": f"""with {FACETS}, {_EDGES}, f as (select *, row_number() over (partition by role, entity order by doc_id) as nth from edges),
j as (select a.doc_id as start_doc, role, entity, b.doc_id from edges a join f b using (role, entity) where nth <= 11 and b.doc_id <> a.doc_id)
select start_doc, role, entity, doc_id, r::int as rank from (select *, row_number() over (partition by start_doc, role, entity order by doc_id) as r from j) where r <= 10""",
    "belief_latest": f"with {_DAY}, l as (select entity, attribute, list_sort(list(distinct value)) as c, any_value(t) as t from (select *, max(t) over (partition by entity, attribute) as m from facts) where t = m group by all) select entity, attribute, case when len(c) = 1 then c[1] end as value, array_to_string(c, ' ') as candidates, t from l",
    "belief_current": f"""with {_DAY}, {_MARGIN}, j as (select entity, attribute, case when len(candidates) = 1 then candidates[1] end as value, candidates, nearest, second, margin, round(margin, 9) < 0.05 as weak from lat join marg using (entity, attribute))
select entity, attribute, value, round(margin, 4) as confidence, value is null or weak as contested, value is null or weak or nearest <> value as to_clarify,
  case when value is null then array_to_string(candidates, ' ') when weak then concat_ws(' ', nearest, second) else '' end as candidates from j""",
    "belief_history": f"with {_TS} select entity, attribute, value, t, row_number() over (partition by entity, attribute order by t, value)::int as place from facts",
    "belief_recency_weight": f"with {_DAY} select entity, attribute, value, count(*) as n, min(age)::int as age, round(sum(power(0.6::double, age)), 6) as w from (select *, dense_rank() over (partition by entity, attribute order by t desc) - 1 as age from facts) group by all",
    "belief_calibration": f"""with {_TS}, {_MARGIN}, p as (select round(margin, 9) as margin, nearest <> candidates[1] as wrong from lat join marg using (entity, attribute) where len(candidates) = 1 and second is not null),
g as (select margin, (select count(*) from p x where x.margin >= m.margin) as kept, (select count(*) from p x where x.margin >= m.margin and wrong) as bad from (select distinct margin from p) m),
b as (select min(margin) as least, arg_min(kept, margin) as kept, arg_min(bad, margin) as bad from g where bad / kept <= 0.05), n as (select count(*) as slots, max(margin) as largest from p)
select case when slots >= 30 then coalesce(least, largest + 1e-9) end as threshold, slots, case when slots >= 30 then round(coalesce(kept, 0) / slots, 4) end as answered, case when slots >= 30 then round(coalesce(bad / kept, 0), 4) end as error from n, b""",
    "belief_resolve": f"""with {_DAY}, {_MARGIN}, c as (select entity, attribute, case when len(candidates) = 1 then candidates[1] end as value, len(candidates) <> 1 or round(margin, 9) < 0.05 or nearest <> candidates[1] as open from lat join marg using (entity, attribute)),
a as (select entity, attribute from facts union select 'nobody', 'last_event' union select 'u1', 'colour'),
e as (select 'u' || user_id as entity, 'last_event' as attribute, event_type as value, round(value, 4) as score from events where value is not null),
s as (select entity, attribute, value, round(sum(score), 4) as proof from (select *, row_number() over (partition by entity, attribute, value order by score desc) as r from e) where r <= 3 group by all),
b as (select entity, attribute, max(value) filter (r = 1) as proved, max(proof) filter (r = 1) as first, coalesce(max(proof) filter (r = 2), 0) as next from (select *, row_number() over (partition by entity, attribute order by proof desc, value) as r from s) where r <= 2 group by all),
j as (select entity, attribute, c.value, open, proved, coalesce(first, 0) as first, round(coalesce(first, 0) - coalesce(next, 0), 4) as margin from a left join c using (entity, attribute) left join b using (entity, attribute)),
k as (select *, case when open is null then 'unknown' when not open then 'clear' when first > 0 and margin >= 0.05 then 'resolved' else 'undecided' end as status from j)
select entity, attribute, status, case when status = 'resolved' then proved else value end as value, margin from k""",
    "empty_filter_report": f"""with {VOC}, {QRY}, {BM25}, h as ({top_sql('bm', 10)}), t as (select qid, doc_id, rank, source as type from h join documents using (doc_id)),
c as (select qid, type, count(*) as n from t group by all)
select qid, sum(n)::bigint as n, (select arg_min(doc_id, rank) from t where t.qid = c.qid) as first_doc, string_agg(type || ':' || n, ' ' order by type) as types from c group by qid having count(*) filter (type = 'src0') = 0""",
    "bind_unbind": f"""with {FACETS}, {_EDGES}, {_BOUND}
select doc_id, role, entity, round(score, 6) as score from ub where score >= 0.15""",
    "html_to_text": r"select page_id, trim(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') as text from pages",
}
