"""Tables and the SQL fragments that several checks begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import TOKEN
from corvane.functions.words import NEGATORS, STOPWORDS
from corvane.operators import corpus
from corvane.session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """(id, text) of a table whose texts are much work, over all cores."""
    key = "item_id" if name == "benchmark" else "doc_id"
    return spread(table(spark, sf_dir, name).select(key, "text"))


def doc_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.token_arrays(texts(spark, sf_dir))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, tokens): each benchmark item as a query, whole."""
    return corpus.token_arrays(table(spark, sf_dir, "benchmark"), id_col="item_id").withColumnRenamed("doc_id", "qid")


def in_sql(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


STOP, NEG = in_sql(STOPWORDS), in_sql(NEGATORS)
#: arr(doc_id, tokens), tok(doc_id, pos, token), n(n): all documents.
TOK = f"""arr as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') as tokens from documents),
tok as (select doc_id, unnest(range(len(tokens))) as pos, unnest(tokens) as token from arr),
n as (select count(*) as n, avg(len(tokens)) as avgdl from arr)"""
#: cnt(doc_id, token, tf), voc(token, df, cf, idf)
VOC = TOK + """,
cnt as (select doc_id, token, count(*) as tf from tok group by all),
voc as (select token, df, cf, ln(1 + n / (1 + df)) as idf from (select token, count(*) as df, sum(tf)::bigint as cf from cnt group by 1), n)"""
#: qpos(qid, pos, token), qry(qid, token, qtf): benchmark_queries
QRY = f"""qarr as (select item_id as qid, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') as tokens from benchmark),
qpos as (select qid, unnest(tokens) as token, unnest(range(len(tokens))) as pos from qarr),
qry as (select qid, token, count(*) as qtf from qpos group by all)"""
#: bm(qid, doc_id, score)
BM25 = """dl as (select doc_id, len(tokens) as dl from arr),
bm as (select qid, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
  from qry join cnt using (token) join voc using (token) join dl using (doc_id), n group by all)"""


def top_sql(scores: str, k: int, score: str = "score", digits: int = 6) -> str:
    return f"""select qid, doc_id, r::int as rank, round({score}, {digits}) as score from (
  select *, row_number() over (partition by qid order by round({score}, 9) desc, doc_id) as r from {scores}) where r <= {k}"""


FACETS = """facets as (
select concat(r_name,'/',n_name,'/',substr(d,1,4),'/',substr(d,6,2),'.',substr(d,1,4),'/',
         case when o_orderkey % 10 = 0 then concat('IMG_',k,'.jpg')
              else concat(replace(d,'-',''),'_',k,
                   case o_orderstatus when 'F' then '.pdf' when 'O' then '.xlsx' else '.md' end) end) as doc_id,
       case when o_orderkey % 10 = 0 then '0000-00-00' else d end as date,
       case when o_orderkey % 10 = 0 then 'photo' when o_orderstatus='F' then 'pdf'
            when o_orderstatus='O' then 'spreadsheet' else 'note' end as type,
       concat('C',k7) as ref
from (select *, cast(cast(o_orderdate as date) as varchar) as d, cast(o_orderkey as varchar) as k,
             lpad(cast(o_custkey as varchar),7,'0') as k7 from orders) o
join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey)"""


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, date, type, refs): a filed document for each order; every tenth is a photo without a date."""
    t = lambda name: table(spark, sf_dir, name)
    d = F.col("o_orderdate").cast("date").cast("string")
    key = F.col("o_orderkey").cast("string")
    photo = F.col("o_orderkey") % 10 == 0
    status = F.col("o_orderstatus")
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ext = F.when(status == "F", ".pdf").when(status == "O", ".xlsx").otherwise(".md")
    name = F.when(photo, F.concat(F.lit("IMG_"), key, F.lit(".jpg"))).otherwise(F.concat(F.replace(d, F.lit("-"), F.lit("")), F.lit("_"), key, ext))
    year = F.substring(d, 1, 4)
    path = F.concat_ws("/", "r_name", "n_name", year, F.concat_ws(".", F.substring(d, 6, 2), year), name)
    kind = F.when(photo, "photo").when(status == "F", "pdf").when(status == "O", "spreadsheet").otherwise("note")
    ref = F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))
    return rows.select(path.alias("doc_id"), F.when(photo, "0000-00-00").otherwise(d).alias("date"), kind.alias("type"), F.array(ref).alias("refs"))
