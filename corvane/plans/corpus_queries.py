"""Queries over texts and what is learned from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import grammar, questions
from corvane.functions import text as T
from corvane.operators import cooc, corpus, diff, evaluate, explain, typed, vectors
from corvane.plans.tables import FACETS, NEG, STOP, TOK, VOC, benchmark_queries, doc_arrays, order_paths, table, texts
from corvane.session import checkpointed, spread

#: A small lexicon of the words that the tables hold.
LEXICON = {"error": "fault", "purchase": "sale", "la": "le", "est": "être", "is": "be", "the": "a", "and": "et"}


def tokenize_counts(spark, d):
    return doc_arrays(spark, d).select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("bigint").alias("n_distinct"))


def doc_length_stats(spark, d):
    s = corpus.length_stats(doc_arrays(spark, d))
    return s.select("n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"), "max_tokens")


def path_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(T.path_tokens(F.col("url")), " ").alias("tokens"))


def vocab_df_idf(spark, d):
    a = doc_arrays(spark, d)
    return corpus.with_idf(corpus.vocabulary(a), a).select("token", "df", "cf", F.round("idf", 6).alias("idf"))


def collocations_pmi(spark, d):
    return corpus.collocations(doc_arrays(spark, d)).select("a", "b", "n_ab", F.round("pmi", 6).alias("pmi"))


def collocation_merge(spark, d):
    return corpus.merged_by_collocations(doc_arrays(spark, d)).select("doc_id", F.array_join("tokens", " ").alias("text"))


def char_ngrams(spark, d):
    words = T.tokens(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.flatten(F.transform(words, lambda w: T.fragments(w, 3))), " ").alias("fragments"))


def unknown_term_fallback(spark, d):
    """Words of the turns of conversations that no document has, as fragments."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), T.tokens(F.col("text")).alias("tokens"))
    vocab = doc_arrays(spark, d).select(F.explode("tokens").alias("token")).distinct()
    out = corpus.unknown_fragments(turns, vocab)
    return out.select("qid", F.array_join("tokens", " ").alias("tokens"))


def lexicon_canonical_unigram(spark, d):
    out = corpus.canonical(doc_arrays(spark, d), [([k], [v]) for k, v in LEXICON.items()])
    return out.select("doc_id", F.array_join("tokens", " ").alias("text"))


def signed_term_counts(spark, d):
    return corpus.signed_counts(doc_arrays(spark, d))


def query_clean(spark, d):
    c = questions.clean(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", c["text"].alias("text"), F.size(c["removed"]).alias("n_removed"), questions.noise_ratio(F.col("text")).alias("noise"))


def query_route(spark, d):
    r = questions.route(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", r["circuit"].alias("circuit"), r["reason"].alias("reason"), F.array_join(r["codes"], " ").alias("codes"), r["kind"].alias("kind"), r["k"].alias("k"))


def doc_refs(spark, d):
    return texts(spark, d).select("doc_id", F.array_join(T.codes(F.col("text")), " ").alias("refs"))


def path_dates(spark, d):
    return order_paths(spark, d).select("doc_id", T.path_date(F.col("doc_id")).alias("date"))


def type_facet(spark, d):
    return order_paths(spark, d).groupBy(T.document_kind(F.col("doc_id")).alias("type")).agg(F.count("*").alias("n"))


def cooccurrence_pairs(spark, d):
    return cooc.pair_weights(doc_arrays(spark, d))


def ppmi_top_neighbors(spark, d):
    return cooc.nearest(doc_arrays(spark, d), 5).select("token", "neighbour", "rank", F.round("ppmi", 6).alias("ppmi"))


def hash_signature(spark, d):
    words = doc_arrays(spark, d).select(F.explode("tokens").alias("token")).distinct()
    return words.select("token", F.array_join(vectors.signature_places(F.col("token")), " ").alias("places"))


def grid_encode_quantize(spark, d):
    g = vectors.document_grids(doc_arrays(spark, d))
    return g.select("doc_id", F.array_join(F.transform("q", lambda x: x.cast("string")), " ").alias("q"), F.round("norm", 6).alias("norm"))


def typed_grid_routing(spark, d):
    r = typed.routed(doc_arrays(spark, d))
    return r.groupBy("doc_id", "grid").agg(F.count("*").alias("words"), F.sum("tf").alias("tokens"))


def heatmap(spark, d):
    h = vectors.heat_map_of(doc_arrays(spark, d))
    return h.select("doc_id", "cell", F.round("w", 6).alias("w"))


def _with_source(spark, d):
    """(doc_id, tokens, source)."""
    return spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", T.tokens(F.col("text")).alias("tokens"), "source")


def boilerplate_terms(spark, d):
    """Words among the top 20 of most documents of one source."""
    return explain.boilerplate(explain.top_terms(_with_source(spark, d), keep=("source",)), "source", 0.05)


def top_terms(spark, d):
    return explain.top_terms(doc_arrays(spark, d))


def held_out_queries(spark, d):
    return evaluate.held_out(doc_arrays(spark, d))


def _halves(spark, d):
    docs = texts(spark, d)
    return docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 <> 1")


def semantic_diff_inventory(spark, d):
    """Two states of the corpus: a tenth of the documents went, another tenth came."""
    before, after = _halves(spark, d)
    docs = diff.document_changes(before, after).select(F.col("doc_id").cast("string").alias("what"), "change")
    a, b = (checkpointed(corpus.token_arrays(x)) for x in (before, after))  # tokens are made once and read several times
    words = diff.word_changes(a, b).select(F.col("token").alias("what"), "change")
    pairs = diff.collocation_changes(a, b).select(F.concat_ws(" ", "a", "b").alias("what"), "change")
    return diff.in_order(docs.unionByName(words).unionByName(pairs))


def usage_drift(spark, d):
    return diff.usage(*(corpus.token_arrays(x) for x in _halves(spark, d)))


def company_drift(spark, d):
    """The halves share most documents, so each is read once and marked with the halves it is in."""
    sides = F.when(F.col("doc_id") % 10 != 0, 1).otherwise(0) + F.when(F.col("doc_id") % 10 != 1, 2).otherwise(0)
    return diff.company_of(doc_arrays(spark, d).withColumn("side", sides).where("side > 0"))


#: Clauses and the roles in them, beside the documents, which hold few.
CLAUSES = {
    "le filtre est en amont du compteur": (("amont", "filtre"), ("aval", "compteur")),
    "le compteur est en amont du filtre": (("amont", "compteur"), ("aval", "filtre")),
    "le toit est en aval du mur": (("aval", "toit"), ("amont", "mur")),
    "une porte sans serrure": (("absent", "serrure"),),
    "la porte et le mur": (),
}


def grammar_roles(spark, d):
    """Who does what in the documents, and in clauses numbered -1, -2, ..."""
    clauses = spark.createDataFrame([(-i, c) for i, c in enumerate(CLAUSES, 1)], "doc_id bigint, text string")
    rows = texts(spark, d).unionByName(clauses)
    return rows.select("doc_id", F.explode(grammar.roles(F.col("text"))).alias("e")).select("doc_id", "e.role", "e.entity")


def identity_card(spark, d):
    """The concepts of each document, without noise and what is common in its source."""
    return explain.identity_cards(_with_source(spark, d), "source", 0.05).select("doc_id", F.array_join("concepts", " ").alias("concepts"))


def explain_document(spark, d):
    """For every document whose number is divisible by 100 the twenty words nearest to its grid."""
    a = doc_arrays(spark, d)
    return explain.nearest_words_of(a, a.where("doc_id % 100 = 0"))


def index_stats(spark, d):
    return explain.stats(doc_arrays(spark, d))


def near_words(spark, d):
    """Words in the company that the benchmark's words keep."""
    asked = benchmark_queries(spark, d).select(F.explode("tokens").alias("token")).distinct()
    return explain.near_words_of(doc_arrays(spark, d), asked)


QUERIES = {f.__name__: f for f in (tokenize_counts, doc_length_stats, path_tokens, vocab_df_idf, collocations_pmi, collocation_merge, char_ngrams, unknown_term_fallback, lexicon_canonical_unigram, signed_term_counts, query_clean, query_route, doc_refs, path_dates, type_facet, cooccurrence_pairs, ppmi_top_neighbors, hash_signature, grid_encode_quantize, typed_grid_routing, heatmap, boilerplate_terms, top_terms, held_out_queries, semantic_diff_inventory, usage_drift, company_drift, grammar_roles, index_stats, near_words, identity_card, explain_document)}


def _pairs_sql(src: str, out: str) -> str:
    """tok -> pair weights; ``src`` is the token table."""
    return f"""{out} as (select least(x.token, y.token) as a, greatest(x.token, y.token) as b, sum(6 - (y.pos - x.pos))::bigint as w
  from {src} x join {src} y on x.doc_id = y.doc_id and y.pos > x.pos and y.pos <= x.pos + 5
  where x.token not in {STOP} and y.token not in {STOP} group by all)"""


def _ppmi_sql(pairs: str, out: str) -> str:
    return f"""{out}_m as (select token, sum(w) as m from (select a as token, w from {pairs} union all select b, w from {pairs}) group by 1),
{out} as (select a, b, w, ln((select sum(w) from {pairs})::double * w / (x.m::double * y.m)) as ppmi from {pairs} join {out}_m x on x.token = a join {out}_m y on y.token = b
  where ln((select sum(w) from {pairs})::double * w / (x.m::double * y.m)) > 0)"""


def _colloc_sql(tok: str, out: str) -> str:
    return f"""{out}_g as (select token as a, lead(token) over (partition by doc_id order by pos) as b from {tok}),
{out}_s as (select token, count(*) as n from {tok} group by 1),
{out} as (select a, b, n_ab, ln(n_ab::double * (select count(*) from {tok}) / (x.n::double * y.n)) as pmi from (
  select a, b, count(*) as n_ab from {out}_g where b is not null and a not in {STOP} and b not in {STOP} group by all having count(*) >= 5)
  join {out}_s x on x.token = a join {out}_s y on y.token = b where ln(n_ab::double * (select count(*) from {tok}) / (x.n::double * y.n)) >= 3)"""


_PLACES = "list_transform(range(80), lambda i: (('0x' || substr(sha256(token || '#' || (i // 16)), (4 * (i % 16) + 1)::int, 4))::int % 768))"
_SIG = f"sig as (select token, place, r from (select *, row_number() over (partition by token order by nth) as r from (select token, place, min(nth) as nth from (select token, unnest({_PLACES}) as place, unnest(range(80)) as nth from words) group by all)) where r <= 40)"
SIGNED = f"""kept as (select * from tok where token in {NEG} or token not in {STOP}),
lagged as (select *, coalesce(lag(token) over (partition by doc_id order by pos), '') in {NEG} as negated from kept),
signed as (select doc_id, token, negated, count(*) as tf from lagged where token not in {NEG} group by all)"""
#: grid(doc_id, idx, q) of every document and place
GRID = f"""words as (select distinct token from tok), {_SIG},
weight as (select doc_id, token, (case when negated then -1 else 1 end) * round((1 + ln(tf)) * idf * 1000000)::bigint as w from signed join voc using (token)),
cell as (select doc_id, place as idx, sum(w * case when r <= 20 then 1 else -1 end)::bigint as v from weight join sig using (token) group by all),
peak as (select doc_id, max(abs(v)) as peak from cell group by 1),
grid as (select a.doc_id, i.idx, coalesce(round_even(v * 127.0::double / peak, 0), 0)::int as q from arr a cross join (select unnest(range(768)) as idx) i left join cell c on c.doc_id = a.doc_id and c.idx = i.idx left join peak p on p.doc_id = a.doc_id)"""


def _rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_KINDS = " ".join(f"when regexp_matches(q, {_rx('(?i)' + questions._L + '(?:' + '|'.join(v) + ')' + questions._R)}) then '{k}'" for k, v in questions.KINDS.items())

def _ordered_distinct(x: str) -> str:
    """A list without repetitions, in order of first appearance."""
    return f"list_transform(list_filter(list_zip({x}, range(1, len({x}) + 1)), lambda p: list_position({x}, p[1]) = p[2]), lambda p: p[1])"


_BARE = "regexp_replace(t, '[^0-9A-Za-z]', '', 'g')"
_REFS = f"list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '{T.CODE}'), lambda t: (length({_BARE}) >= 5 and regexp_matches({_BARE}, '[A-Za-z]') and regexp_matches({_BARE}, '[0-9]')) or (length({_BARE}) >= 6 and regexp_matches({_BARE}, '^[0-9]+$'))), lambda t: upper({_BARE}))"


def _date_sql(x: str, p: str) -> str:
    return f"case when regexp_matches({x}, '{p}') then concat_ws('-', regexp_extract({x}, '{p}', 1), regexp_extract({x}, '{p}', 2), regexp_extract({x}, '{p}', 3)) end"


_STATES = """arr as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '%s') as tokens from documents),
tok as (select doc_id, unnest(range(len(tokens))) as pos, unnest(tokens) as token from arr),
t1 as (select * from tok where doc_id %% 10 <> 0), t2 as (select * from tok where doc_id %% 10 <> 1)""" % T.TOKEN

SQL = {
    "tokenize_counts": f"with {TOK} select doc_id, len(tokens)::bigint as n_tokens, len(list_distinct(tokens))::bigint as n_distinct from arr",
    "doc_length_stats": f"with {TOK} select count(*) as n_docs, sum(len(tokens))::bigint as n_tokens, round(avg(len(tokens)), 6) as avgdl, max(len(tokens))::bigint as max_tokens from arr",
    "path_tokens": rf"select page_id, array_to_string(regexp_extract_all(lower(regexp_replace(url, '[./_-]', ' ', 'g')), '{T.TOKEN}'), ' ') as tokens from pages",
    "vocab_df_idf": f"with {VOC} select token, df, cf, round(idf, 6) as idf from voc",
    "collocations_pmi": f"with {TOK}, {_colloc_sql('tok', 'c')} select a, b, n_ab, round(pmi, 6) as pmi from c",
    "collocation_merge": f"""with {TOK}, {_colloc_sql('tok', 'c')},
m as (select doc_id, pos, token, nxt, c.a is not null as hit from (select *, lead(token) over (partition by doc_id order by pos) as nxt from tok) t left join c on c.a = t.token and c.b = t.nxt),
z as (select *, coalesce(max(case when not hit then pos end) over (partition by doc_id order by pos), -1) as reset from m),
s as (select *, hit and (pos - reset) % 2 = 1 as starts from z),
k as (select *, coalesce(lag(starts) over (partition by doc_id order by pos), false) as taken from s)
select arr.doc_id, coalesce(text, '') as text from arr left join (
  select doc_id, string_agg(case when starts then token || '_' || nxt else token end, ' ' order by pos) as text from k where not taken group by 1) x using (doc_id)""",
    "char_ngrams": f"""with w as (select p_partkey, regexp_extract_all(lower(p_name), '{T.TOKEN}') as words from part)
select p_partkey, array_to_string(flatten(list_transform(words, lambda w: case when length(w) > 3 then list_transform(range(1, length(w) + 1), lambda i: '§' || substr('^' || w || '$', i::int, 3)) else [] end)), ' ') as fragments from w""",
    "unknown_term_fallback": f"""with {TOK}, v as (select distinct token from tok),
q as (select conv_id * 1000 + turn as qid, regexp_extract_all(lower(coalesce(text, '')), '{T.TOKEN}') as tokens from conversations),
p as (select qid, unnest(tokens) as token, unnest(range(len(tokens))) as pos from q),
f as (select qid, string_agg(array_to_string(list_transform(range(1, length(token) + 1), lambda i: '§' || substr('^' || token || '$', i::int, 3)), ' '), ' ' order by pos) as extra
  from p where token not in (select token from v) and length(token) > 3 group by 1)
select q.qid, concat_ws(' ', nullif(array_to_string(tokens, ' '), ''), extra) as tokens from q left join f using (qid)""",
    "lexicon_canonical_unigram": f"with {TOK} select arr.doc_id, coalesce(text, '') as text from arr left join (select doc_id, string_agg(case token {' '.join(f"when '{k}' then '{v}'" for k, v in LEXICON.items())} else token end, ' ' order by pos) as text from tok group by 1) x using (doc_id)",
    "signed_term_counts": f"with {TOK}, {SIGNED} select * from signed",
    "query_route": rf"""with s as (select conv_id, turn, trim(coalesce(text, '')) as q from conversations where text is not null),
c as (select *, list_filter(list_transform(regexp_extract_all(q, {_rx(questions.WORDS)}), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')),
  lambda w: ((regexp_matches(w, '^[A-Z0-9-]{{5,}}$') and regexp_matches(w, '[A-Z]') and regexp_matches(w, '[0-9]')) or regexp_matches(w, '^[0-9]{{6,}}$'))
    and not regexp_matches(w, {_rx(questions._YEAR)}) and not regexp_matches(w, {_rx(questions._MEASURE)})) as found from s),
r as (select *, case when q = '' then 'empty' when regexp_matches(q, {_rx(questions.METHOD)}) then 'method'
  when regexp_matches(q, {_rx(questions.COUNT)}) and not regexp_matches(q, {_rx(questions.NOT_COUNT)}) then 'count'
  when regexp_matches(q, {_rx(questions.ORDER)}) and not regexp_matches(q, {_rx(questions.NOT_ORDER)}) then 'order'
  when len(found) > 0 then 'code' else 'default' end as reason from c)
select conv_id, turn, case reason when 'count' then 'count' when 'order' then 'order' when 'code' then 'reference' else 'semantic' end as circuit, reason,
  case when reason in ('count', 'order', 'code') then array_to_string({_ordered_distinct('found')}, ' ') else '' end as codes,
  case {_KINDS} end as kind, case when reason = 'order' then nullif(regexp_extract(q, {_rx(questions.LATEST)}, 1), '')::int end as k from r""",
    "doc_refs": f"with r as (select doc_id, {_REFS} as x from documents) select doc_id, array_to_string(list_slice({_ordered_distinct('x')}, 1, {T.MAX_CODES}), ' ') as refs from r",
    "path_dates": rf"""with {FACETS}, p as (select doc_id, regexp_extract(doc_id, '([^/]*)$', 1) as name from facets)
select doc_id, coalesce({_date_sql('name', T.DASHED)}, {_date_sql('doc_id', T.DASHED)}, {_date_sql('name', T.COMPACT)}, {_date_sql('doc_id', T.COMPACT)},
  case when regexp_matches(doc_id, '{T.FOLDER}') then regexp_extract(doc_id, '{T.FOLDER}', 1) || '-' || regexp_extract(doc_id, '{T.FOLDER}', 2) || '-00' end, '{T.NO_DATE}') as date from p""",
    "type_facet": f"""with {FACETS} select case regexp_extract(doc_id, '[^.]\\.([^./]+)$', 1) when 'xlsx' then 'spreadsheet' when 'jpg' then 'photo' when 'pdf' then 'scanned pdf' else 'note' end as type, count(*) as n from facets group by 1""",
    "cooccurrence_pairs": f"with {TOK}, {_pairs_sql('tok', 'p')} select * from p",
    "ppmi_top_neighbors": f"""with {TOK}, {_pairs_sql('tok', 'p')}, {_ppmi_sql('p', 's')},
b as (select a as token, b as neighbour, ppmi from s union all select b, a, ppmi from s where a <> b)
select token, neighbour, r::int as rank, round(ppmi, 6) as ppmi from (select *, row_number() over (partition by token order by round(ppmi, 9) desc, neighbour) as r from b) where r <= 5""",
    "hash_signature": f"with {TOK}, words as (select distinct token from tok), {_SIG} select token, string_agg(place::varchar, ' ' order by r) as places from sig group by 1",
    "grid_encode_quantize": f"with {VOC}, {SIGNED}, {GRID} select doc_id, string_agg(q::varchar, ' ' order by idx) as q, round(sqrt(sum(q * q)), 6) as norm from grid group by 1",
    "typed_grid_routing": f"""with {VOC}, g as (select *, regexp_replace(token, '[^0-9A-Za-z]', '', 'g') as b from cnt)
select doc_id, case when (length(b) >= 5 and regexp_matches(b, '[A-Za-z]') and regexp_matches(b, '[0-9]')) or (length(b) >= 6 and regexp_matches(b, '^[0-9]+$')) then 'code' else 'meaning' end as grid,
  count(*) as words, sum(tf)::bigint as tokens from g group by all""",
    "heatmap": f"with {VOC} select doc_id, (('0x' || substr(sha256(token), 1, 6))::int % 4096)::int as cell, round(sum(tf * idf), 6) as w from cnt join voc using (token) group by all",
    "top_terms": f"""with {VOC}, w as (select doc_id, token, round((1 + ln(tf)) * idf, 6) as weight from cnt join voc using (token) where token not in {STOP})
select doc_id, token, r::int as rank, weight from (select *, row_number() over (partition by doc_id order by weight desc, token) as r from w) where r <= 20""",
    "boilerplate_terms": f"""with {VOC}, w as (select doc_id, token, round((1 + ln(tf)) * idf, 6) as weight from cnt join voc using (token) where token not in {STOP}),
t as (select doc_id, token, source from (select *, row_number() over (partition by doc_id order by weight desc, token) as r from w) join documents using (doc_id) where r <= 20),
s as (select source, count(distinct doc_id) as "of" from t group by 1)
select source, token, n, "of" from (select source, token, count(distinct doc_id) as n from t group by all) join s using (source) where "of" >= 2 and n > 0.05 * "of\"""",
    "held_out_queries": f"""with {VOC}, h as (select tok.doc_id, token, count(*) as tf from tok join arr using (doc_id) where len(tokens) >= 40 and pos >= len(tokens) // 2 and token not in {STOP} group by all),
r as (select *, row_number() over (partition by doc_id order by round(tf * idf, 9) desc, token) as r from h join voc using (token))
select doc_id, string_agg(token, ' ' order by r) as query from r where r <= 6 group by 1""",
    "semantic_diff_inventory": f"""with {_STATES}, {_colloc_sql('t1', 'c1')}, {_colloc_sql('t2', 'c2')}
select *, row_number() over (partition by change order by what)::int as place from (select doc_id::varchar as what, case when doc_id % 10 = 0 then 'added' else 'removed' end as change from documents where doc_id % 10 in (0, 1)
union all select token, 'appeared' from (select token from t2 except select token from t1) union all select token, 'vanished' from (select token from t1 except select token from t2)
union all select a || ' ' || b, 'born' from (select a, b from c2 except select a, b from c1) union all select a || ' ' || b, 'dead' from (select a, b from c1 except select a, b from c2))""",
    "grammar_roles": "select * from (values " + ", ".join(f"(-{i}::bigint, '{r}', '{e}')" for i, found in enumerate(CLAUSES.values(), 1) for r, e in found) + ") v(doc_id, role, entity)",
    "identity_card": f"""with {VOC}, w as (select doc_id, token, round((1 + ln(tf)) * idf, 6) as weight from cnt join voc using (token) where token not in {STOP}),
t as (select * from (select *, row_number() over (partition by doc_id order by weight desc, token) as r from w) where r <= 20), s as (select source, count(*) as docs from documents where doc_id in (select doc_id from t) group by 1),
b as (select distinct token from (select source, token, count(distinct doc_id) as n from t join documents using (doc_id) group by all) join s using (source) where docs >= 2 and n > 0.05 * docs),
m as (select *, token in (select token from b) or length(token) < 3 or regexp_matches(token, '^[0-9.,%€-]+$') as gone from t),
k as (select *, row_number() over (partition by doc_id order by gone, r) as place from m)
select doc_id, string_agg(token, ' ' order by place) as concepts from k where place <= 8 and (not gone or place <= 3) group by 1""",
    "explain_document": f"""with {VOC}, {SIGNED}, {GRID}, gn as (select doc_id, sqrt(sum(q * q)) as n from grid where doc_id % 100 = 0 group by 1 having sum(q * q) > 0),
s as (select g.doc_id, token, sum(g.q * case when r <= 20 then 1 else -1 end) / (any_value(n) * sqrt(40)) as score from grid g join gn using (doc_id) join sig on place = idx group by all)
select doc_id, token, r::int as rank, round(score, 6) as score from (select *, row_number() over (partition by doc_id order by round(score, 9) desc, token) as r from s) where r <= 20""",
    "near_words": f"""with {VOC}, {_pairs_sql('tok', 'p')}, {_ppmi_sql('p', 's')}, q0 as (select distinct unnest(regexp_extract_all(lower(coalesce(text, '')), '{T.TOKEN}')) as token from benchmark),
b as (select a as token, b as other, ppmi from s union all select b, a, ppmi from s where a <> b), nrm as (select token, sqrt(sum(ppmi * ppmi)) as norm, count(*) as partners from b group by 1),
u as (select nrm.token, norm from nrm join voc using (token), n where df <= 0.4 * n and partners <= (select quantile_cont(partners, 0.85) from nrm) and nrm.token not in {STOP}),
q as (select token as asked, other, ppmi as x from b where token in (select token from q0)),
d as (select asked, b.token, sum(x * ppmi) as dot from q join b using (other) where b.token <> asked group by all),
r as (select asked as token, d.token as near, round(dot / (u.norm * nrm.norm), 6) as score from d join u on u.token = d.token join nrm on nrm.token = asked)
select token, near, r::int as rank, score from (select *, row_number() over (partition by token order by score desc, near) as r from r) where r <= 10""",
    "usage_drift": f"""with {_STATES}, a as (select token, count(distinct doc_id) as df_before from t1 group by 1), b as (select token, count(distinct doc_id) as df_after from t2 group by 1)
select token, df_before, df_after, round((df_after - df_before) / greatest(df_before, df_after), 6) as ratio from a join b using (token) where greatest(df_before, df_after) >= 3 and df_before <> df_after""",
    "company_drift": f"""with {_STATES}, {_pairs_sql('t1', 'p1')}, {_ppmi_sql('p1', 's1')}, {_pairs_sql('t2', 'p2')}, {_ppmi_sql('p2', 's2')},
d as (select token from (select token from t1 group by 1 having count(distinct doc_id) >= 3) semi join (select token from t2 group by 1 having count(distinct doc_id) >= 3) x using (token)),
x as (select a as token, b as other, ppmi from s1 union all select b, a, ppmi from s1 where a <> b), y as (select a as token, b as other, ppmi from s2 union all select b, a, ppmi from s2 where a <> b),
j as (select token, coalesce(x.ppmi, 0) as p, coalesce(y.ppmi, 0) as q from x full join y using (token, other) where token in (select token from d))
select token, round(case when max(abs(p - q)) = 0 then 0 when sum(p * p) = 0 or sum(q * q) = 0 then 1 else 1 - sum(p * q) / sqrt(sum(p * p) * sum(q * q)) end, 6) as drift from j group by 1""",
    "index_stats": f"with {TOK} select count(*) as n_docs, sum(len(tokens))::bigint as n_tokens, (select count(distinct token) from tok) as n_words, count(*) filter (len(tokens) = 0) as empty_docs from arr",
}
