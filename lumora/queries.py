"""The library's queries over the test tables, each with the same result in SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.frame import SemFrame
from lumora.functions import metrics, text, variants, vectors
from lumora.operators import embedding, index, joins, relational, sketches, table_functions, topk, tree
from lumora.plans.judges import Field, Judge, Pairs
from lumora.sources import scan
from lumora.sources.catalog import Catalog
from lumora.streaming import state, windows
from lumora.tables import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


#: What the instructions below mean, as columns.
JUDGE = Judge(rules={
    "The text is in English and longer than 500 characters.": lambda d: (F.col("lang") == "en") & (F.col("n_chars") > 500),
    "The text mentions a license.": lambda d: F.lower("text").like("%license%"),
    "the script of the first letter": lambda d: F.when(F.col("text").rlike("^[A-Za-z]"), "latin").when(F.col("text").rlike("^[0-9]"), "digit").otherwise("other"),
    "whether the text is short, medium or long": lambda d: F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "medium").otherwise("long"),
    "the first word, in lower case": lambda d: F.lower(F.regexp_extract("text", r"^([^ \n]*)", 1)),
    "the number k of the properties": lambda d: F.get_json_object("props", "$.k"),
    "The lines of the text that are not blank.": lambda d: F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("long").alias("line_no"), x.alias("line"))), lambda s: F.trim(s["line"]) != ""
    ),
    "The customer and the supplier live in one nation, and the supplier has the larger balance.": lambda: Pairs(
        (("nationkey", "nationkey"),), lambda a, b: b("acctbal") > a("acctbal")
    ),
    "Total quantity, mean discount and latest day of all items.": lambda d: {
        "total": F.round(F.sum("l_quantity"), 2), "mean_discount": F.round(F.avg("l_discount"), 6), "latest": F.max("l_shipdate").cast("date"),
    },
    "the kind of the part's type": lambda d: F.split_part("p_type", F.lit(" "), F.lit(1)),
})


@query("""SELECT CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'medium' ELSE 'long' END AS size_class, count(*) AS n,
          CAST(sum(n_chars) AS DOUBLE) AS chars, max(n_chars) AS longest
          FROM documents WHERE lang = 'en' AND n_chars > 500 GROUP BY 1""")
def flagship(spark, sf_dir):
    docs = SemFrame(Tables(spark, sf_dir).documents, JUDGE)
    kept = docs.sem_filter("The text is in English and longer than 500 characters.")
    return kept.sem_groupby(
        [Field("size_class", "string", "whether the text is short, medium or long")],
        [("n_chars", "count", "n"), ("n_chars", "sum", "chars"), ("n_chars", "max", "longest")],
    ).df


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def sem_filter_lang(spark, sf_dir):
    return SemFrame(Tables(spark, sf_dir).documents, JUDGE).sem_filter("The text is in English and longer than 500 characters.").df.select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%license%'")
def sem_filter_keyword(spark, sf_dir):
    return SemFrame(Tables(spark, sf_dir).documents, JUDGE).sem_filter("The text mentions a license.").df.select("doc_id", "source")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def sem_filter_label_semi(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.join(t.labels.where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "n_chars")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '^[A-Za-z]') THEN 'latin' WHEN regexp_matches(text, '^[0-9]') THEN 'digit' ELSE 'other' END AS script,
           lower(regexp_extract(text, '^([^ \n]*)', 1)) AS first_word,
           CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'medium' ELSE 'long' END AS size_class FROM documents""")
def sem_map_fields(spark, sf_dir):
    fields = [
        Field("script", "string", "the script of the first letter"), Field("first_word", "string", "the first word, in lower case"),
        Field("size_class", "string", "whether the text is short, medium or long"),
    ]
    return SemFrame(Tables(spark, sf_dir).documents, JUDGE).sem_map(fields).df.select("doc_id", "script", "first_word", "size_class")


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def sem_map_json(spark, sf_dir):
    return SemFrame(Tables(spark, sf_dir).events, JUDGE).sem_map([Field("k", "bigint", "the number k of the properties")]).df.select("event_id", "k")


@query(r"""SELECT doc_id, source, CAST(i - 1 AS BIGINT) AS line_no, ls[i] AS line FROM
           (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents))
           WHERE trim(ls[i]) <> ''""")
def sem_flat_map_lines(spark, sf_dir):
    docs = SemFrame(Tables(spark, sf_dir).documents, JUDGE)
    found = docs.sem_flat_map([Field("line_no", "bigint"), Field("line", "string")], "The lines of the text that are not blank.")
    return found.df.select("doc_id", "source", "line_no", "line")


@query("""SELECT c_custkey AS custkey, s_suppkey AS suppkey, c_nationkey AS left_nationkey, s_nationkey AS right_nationkey,
          c_acctbal AS left_acctbal, s_acctbal AS right_acctbal FROM customer JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal > c_acctbal""")
def sem_join_prefix(spark, sf_dir):
    t = Tables(spark, sf_dir)
    left = SemFrame(t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal")), JUDGE)
    right = SemFrame(t.supplier.select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal")))
    return left.sem_join(right, "The customer and the supplier live in one nation, and the supplier has the larger balance.").df


@query("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name")
def sem_join_self_pairs(spark, sf_dir):
    return relational.self_pairs(Tables(spark, sf_dir).nation, ["n_regionkey"], "n_name", "one", "other")


@query("SELECT round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean_discount, CAST(max(l_shipdate) AS DATE) AS latest FROM lineitem")
def sem_agg_all(spark, sf_dir):
    fields = [Field("total", "double"), Field("mean_discount", "double"), Field("latest", "date")]
    return SemFrame(Tables(spark, sf_dir).lineitem, JUDGE).sem_aggregate("Total quantity, mean discount and latest day of all items.", fields).df


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(coalesce(sum(CAST(l_quantity AS DOUBLE)), 0.0), 2) AS total,
          round(avg(l_extendedprice), 4) AS mean_price, min(l_discount) AS least, max(l_tax) AS most FROM lineitem GROUP BY 1, 2""")
def sem_groupby_builtin(spark, sf_dir):
    found = SemFrame(Tables(spark, sf_dir).lineitem, JUDGE).sem_groupby(
        [Field("l_returnflag"), Field("l_linestatus")],
        [("l_quantity", "count", "n"), ("l_quantity", "sum", "total"), ("l_extendedprice", "mean", "mean_price"), ("l_discount", "min", "least"), ("l_tax", "max", "most")],
    ).df
    return found.withColumns({"total": F.round("total", 2), "mean_price": F.round("mean_price", 4)})


@query("SELECT split_part(p_type, ' ', 1) AS kind, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price FROM part GROUP BY 1")
def sem_groupby_derived_key(spark, sf_dir):
    found = SemFrame(Tables(spark, sf_dir).part, JUDGE).sem_groupby(
        [Field("kind", "string", "the kind of the part's type")], [("p_partkey", "count", "n"), ("p_retailprice", "mean", "mean_price")]
    ).df
    return found.withColumn("mean_price", F.round("mean_price", 4))


@query("""SELECT c_mktsegment, count(*) AS n, round(coalesce(sum(o_totalprice), 0.0), 2) AS total, round(avg(o_totalprice), 4) AS mean
          FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey GROUP BY 1""")
def sem_groupby_null_semantics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left")
    found = SemFrame(rows).sem_groupby([Field("c_mktsegment")], [("o_totalprice", "count", "n"), ("o_totalprice", "sum", "total"), ("o_totalprice", "mean", "mean")]).df
    return found.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


#: A query vector by a rule, the same in SQL.
DIM = 64
VECTOR = [((i * 7) % 11 - 5) / 10.0 for i in range(DIM)]
SQL_VECTOR = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"


def _topk(metric: str):
    def run(spark, sf_dir):
        found = topk.sem_topk(Tables(spark, sf_dir).embeddings, VECTOR, 10, vector_col="embedding", id_col="vec_id", metric=metric)
        return found.select("vec_id", F.round("score", 6).alias("score"))

    return run


for _name, _sql, _order in (
    ("l2", "list_distance(embedding::DOUBLE[], q) * list_distance(embedding::DOUBLE[], q)", ""),
    ("dot", "list_dot_product(embedding::DOUBLE[], q)", "DESC"),
    ("cosine", "list_cosine_similarity(embedding::DOUBLE[], q)", "DESC"),
):
    QUERIES[f"topk_{_name}"] = _topk(_name)
    ORACLE_SQL[f"topk_{_name}"] = (
        f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_sql} AS s FROM (SELECT *, {SQL_VECTOR} AS q FROM embeddings)) ORDER BY s {_order}, vec_id LIMIT 10"
    )

SQL_NEAR = f"""c AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x
    FROM (SELECT label, embedding, unnest(range(1, {DIM + 1})) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
    near AS (SELECT label, list_distance(m, {SQL_VECTOR}) AS d FROM c)"""


@query(f"""WITH {SQL_NEAR} SELECT vec_id, label, round(s * s, 6) AS score FROM (SELECT vec_id, label, list_distance(embedding::DOUBLE[], {SQL_VECTOR}) AS s FROM embeddings
           WHERE label IN (SELECT label FROM near ORDER BY d, label LIMIT 3)) ORDER BY s, vec_id LIMIT 10""")
def topk_ivf_label(spark, sf_dir):
    """By centroids that are stored beside the rows, which lie in a folder for each cluster: a query reads those of three."""
    rows, place = Tables(spark, sf_dir).embeddings, new_path(spark, "clusters")
    rows.write.partitionBy("label").parquet(f"{place}/rows")
    topk.centroids(rows, "embedding", "label").write.parquet(f"{place}/centers")
    stored = spark.read.schema(rows.schema).parquet(f"{place}/rows")
    options = {"vector_col": "embedding", "id_col": "vec_id", "cluster_col": "label", "centers": spark.read.parquet(f"{place}/centers")}
    found = topk.routed_topk(stored, VECTOR, 10, probes=3, **options)
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_NEAR} SELECT vec_id, label FROM embeddings JOIN near USING (label) ORDER BY d, label, vec_id LIMIT 25")
def topk_best_first(spark, sf_dir):
    found = topk.best_first(Tables(spark, sf_dir).embeddings, VECTOR, 25, vector_col="embedding", id_col="vec_id", cluster_col="label")
    return found.select("vec_id", "label")


@query(f"""SELECT vec_id, label FROM (SELECT vec_id, label FROM embeddings ORDER BY list_dot_product(embedding::DOUBLE[], {SQL_VECTOR}) DESC, vec_id LIMIT 50) WHERE label < 5""")
def filter_after_topk(spark, sf_dir):
    near = topk.sem_topk(Tables(spark, sf_dir).embeddings, VECTOR, 50, vector_col="embedding", id_col="vec_id", metric="dot")
    return near.where("label < 5").select("vec_id", "label")


@query(f"""SELECT vec_id, label FROM (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], {SQL_VECTOR}) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 40)
           ORDER BY CASE WHEN label < 5 THEN label END DESC NULLS LAST, s DESC, vec_id LIMIT 8""")
def topk_reranked(spark, sf_dir):
    rerank = F.when(F.col("label") < 5, F.col("label"))
    return topk.reranked_topk(Tables(spark, sf_dir).embeddings, VECTOR, 8, rerank, vector_col="embedding", id_col="vec_id").select("vec_id", "label")


@query(r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[^ \n\r\t]+')) AS w FROM benchmark),
           c AS (SELECT item_id, ('0x' || substr(md5(w), 1, 6))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2),
           v AS (SELECT item_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS weight FROM c)
           SELECT a.item_id, round(sum(a.weight * b.weight), 6) AS score FROM v a JOIN v b ON a.bucket = b.bucket AND b.item_id = 0
           GROUP BY a.item_id ORDER BY score DESC, a.item_id LIMIT 10""")
def topk_hashed_texts(spark, sf_dir):
    vectors_ = embedding.hashed_words(Tables(spark, sf_dir).benchmark, "item_id", "text", 64)
    return embedding.nearest_texts(vectors_, vectors_.where("item_id = 0"), "item_id", 10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def limit_ordered(spark, sf_dir):
    return SemFrame(Tables(spark, sf_dir).orders.orderBy(F.desc("o_totalprice"), "o_orderkey")).limit(20).df.select("o_orderkey", "o_totalprice")


@query("""SELECT doc_id, CAST(i AS BIGINT) AS position, substring(text, i * 500 + 1, 500) AS chunk FROM
          (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 500 + 1)) AS i FROM documents WHERE length(text) > 0)""")
def chunk_text(spark, sf_dir):
    found = text.chunked(Tables(spark, sf_dir).documents.select("doc_id", "text"), "text", 500)
    return found.withColumn("position", F.col("position").cast("long"))


@query("SELECT doc_id, length(text) // 4 + 1 AS tokens, greatest(1, least((length(text) // 4 + 1) // 32, 100)) AS chunk_tokens FROM documents")
def token_counts(spark, sf_dir):
    tokens = text.count_tokens(F.col("text"))
    return Tables(spark, sf_dir).documents.select("doc_id", tokens.alias("tokens"), text.chunk_size(tokens, 1000).alias("chunk_tokens"))


@query("""WITH c AS (SELECT doc_id, i, substring(text, i * 400 + 1, 400) AS c FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 400 + 1)) AS i FROM documents)),
          r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (length(c) - length(replace(c, 'the', ''))) DESC, i) AS k FROM c),
          u AS (SELECT *, sum(length(c) // 4 + 1) OVER (PARTITION BY doc_id ORDER BY k) AS used FROM r),
          f AS (SELECT *, used <= 300 OR k = 1 AS fits FROM u)
          SELECT doc_id, CASE WHEN bool_and(fits) THEN string_agg(c, '' ORDER BY i) ELSE string_agg(c, '...' ORDER BY i) FILTER (fits) END AS text FROM f GROUP BY doc_id""")
def truncate_budget(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text")
    return text.fit_text(docs, "text", 300, chars=400, score=lambda c: F.length(c) - F.length(F.replace(c, F.lit("the"), F.lit(""))))


@query("""WITH d AS (SELECT page_id, url, html, coalesce(length(url) // 4 + 1, 0) + coalesce(length(html) // 4 + 1, 0) AS tokens FROM pages),
          c AS (SELECT page_id, 0 AS f, i, substring(url, i * 40 + 1, 40) AS c FROM (SELECT page_id, url, unnest(range(0, (length(url) - 1) // 40 + 1)) AS i FROM d WHERE length(url) > 0)
                UNION ALL SELECT page_id, 1, i, substring(html, i * 40 + 1, 40) FROM (SELECT page_id, html, unnest(range(0, (length(html) - 1) // 40 + 1)) AS i FROM d WHERE length(html) > 0)),
          r AS (SELECT *, row_number() OVER (PARTITION BY page_id, f ORDER BY length(c) - length(replace(c, '<', '')) DESC, i) AS k FROM c),
          u AS (SELECT *, sum(length(c) // 4 + 1) OVER (PARTITION BY page_id ORDER BY k, f ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY page_id ORDER BY k, f) AS turn FROM r),
          t AS (SELECT page_id, string_agg(c, '...' ORDER BY i) FILTER (f = 0) AS url, string_agg(c, '...' ORDER BY i) FILTER (f = 1) AS html FROM u WHERE used <= 100 OR turn = 1 GROUP BY 1)
          SELECT page_id, CASE WHEN d.url IS NULL OR tokens <= 100 THEN d.url ELSE coalesce(t.url, '') END AS url,
                 CASE WHEN d.html IS NULL OR tokens <= 100 THEN d.html ELSE coalesce(t.html, '') END AS html FROM d LEFT JOIN t USING (page_id)""")
def truncate_record(spark, sf_dir):
    pages = Tables(spark, sf_dir).pages.select("page_id", "url", "html")
    return text.fit_record(pages, ["url", "html"], 100, chars=40, score=lambda c: F.length(c) - F.length(F.replace(c, F.lit("<"), F.lit(""))))


@query("""WITH t AS (SELECT doc_id, length(text) // 4 + 1 AS tokens FROM documents)
          SELECT doc_id, tokens, CAST(tokens * 100000 // (SELECT CAST(sum(tokens) AS BIGINT) FROM t) AS BIGINT) AS share FROM t""")
def agg_budget_share(spark, sf_dir):
    counted = Tables(spark, sf_dir).documents.select("doc_id", text.count_tokens(F.col("text")).alias("tokens"))
    return text.budget_share(counted, "tokens", 100000)


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 100000")
def count_where(spark, sf_dir):
    return Tables(spark, sf_dir).orders.where(F.col("o_orderpriority").like("1%") & (F.col("o_totalprice") > 100000)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) / count(*), 6) AS share FROM orders")
def ratio(spark, sf_dir):
    return Tables(spark, sf_dir).orders.agg(F.round(relational.ratio(F.col("o_orderstatus") == "F"), 6).alias("share"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT * FROM c WHERE n = (SELECT max(n) FROM c)""")
def group_max_ties(spark, sf_dir):
    return relational.most_with_ties(Tables(spark, sf_dir).customer, ["c_nationkey", "c_mktsegment"])


@query("SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def union_distinct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"))
    return a.union(t.supplier.where("s_acctbal > 5000").select("s_nationkey")).distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""(SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)
          INTERSECT (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))""")
def intersect(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rich = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey")).union(t.supplier.where("s_acctbal > 8000").select("s_nationkey"))
    return rich.intersect(t.nation.where(F.col("n_regionkey").isin(1, 3)).select("n_nationkey"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R')")
def semi_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    items = t.lineitem.where("l_quantity >= 49 AND l_returnflag = 'R'")
    return t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderdate")


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal < -500 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1),
          n AS (SELECT n_nationkey AS k, n_name FROM nation WHERE n_regionkey < 3)
          SELECT k AS nationkey, CAST((customers IS NOT NULL)::INT + (suppliers IS NOT NULL)::INT + (n_name IS NOT NULL)::INT AS BIGINT) AS sides
          FROM c FULL JOIN s USING (k) FULL JOIN n USING (k) WHERE (customers IS NOT NULL)::INT + (suppliers IS NOT NULL)::INT + (n_name IS NOT NULL)::INT >= 2""")
def outer_join_nonnull(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t.customer.where("c_acctbal < -500").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    n = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    sides = sum(F.col(x).isNotNull().cast("long") for x in ("customers", "suppliers", "n_name"))
    return c.join(s, "nationkey", "outer").join(n, "nationkey", "outer").select("nationkey", sides.alias("sides")).where("sides >= 2")


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(DISTINCT o_orderkey) AS n_orders
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def multiway_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = (
        t.lineitem.where("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.groupBy("r_name", "n_name").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders")
    )


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY 1")
def argmax_by_group(spark, sf_dir):
    return relational.argmax(Tables(spark, sf_dir).orders, ["o_custkey"], "o_totalprice", "o_orderkey", "best")


@query("SELECT p_partkey, split_part(p_name, ' ', 2) AS noun, TRY_CAST(split_part(p_brand, '#', 2) AS BIGINT) AS brand_no FROM part")
def split_part_cast(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(
        "p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"), F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("bigint").alias("brand_no")
    )


@query("""SELECT word, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY p_size) AS sizes FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word, p_size FROM part) GROUP BY 1""")
def string_agg(spark, sf_dir):
    words = Tables(spark, sf_dir).part.select(F.explode(F.split("p_name", " ")).alias("word"), "p_size").distinct()
    return words.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_size")), lambda x: x.cast("string")), ",").alias("sizes"))


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_cols(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("lang", "source").distinct()


@query("""SELECT event_type, mean, rank() OVER (ORDER BY mean DESC) AS place FROM (SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1)""")
def avg_by_group_rank(spark, sf_dir):
    return relational.ranked_means(Tables(spark, sf_dir).events, "event_type", F.col("value"))


@query("SELECT doc_id, to_json(struct_pack(lang := lower(lang), source := source)) AS facts FROM documents WHERE n_chars > 3000")
def json_facts(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.where("n_chars > 3000")
    return docs.select("doc_id", F.to_json(F.struct(F.lower("lang").alias("lang"), "source")).alias("facts"))


@query("SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['ring'])")
def list_containment(spark, sf_dir):
    words = F.split("p_name", " ")
    return Tables(spark, sf_dir).part.where(F.size(F.array_except(F.array(F.lit("ring")), words)) == 0).select("p_partkey")


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders")
def running_totals(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return Tables(spark, sf_dir).orders.select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(order), 2).alias("running"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("""SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
          UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def terminal_union_ragged(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = SemFrame(t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    return a.union(SemFrame(t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))).df


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 20")
def sample_deterministic(spark, sf_dir):
    return SemFrame(Tables(spark, sf_dir).documents).sample("doc_id", 20).df.select("doc_id", "lang")


def _guesses(spark, sf_dir) -> DataFrame:
    """Labels beside what a rule says of them: junk signs make a text bad."""
    t = Tables(spark, sf_dir)
    guess = F.when(F.col("text").rlike("[&%$#|]"), 0).otherwise(1)
    return t.labels.join(t.documents, "doc_id").select("doc_id", "quality", "toxic", "source", "lang", "n_chars", guess.alias("guess"))


SQL_GUESSES = "g AS (SELECT doc_id, quality, toxic, source, lang, n_chars, CASE WHEN regexp_matches(text, '[&%$#|]') THEN 0 ELSE 1 END AS guess FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {SQL_GUESSES}, c AS (SELECT sum((guess = 0 AND quality = 0)::INT) AS tp, sum((guess = 0)::INT) AS nf, sum((quality = 0)::INT) AS nt FROM g)
           SELECT round(tp / nf, 6) AS precision, round(tp / nt, 6) AS recall, round(2 * (tp / nf) * (tp / nt) / (tp / nf + tp / nt), 6) AS f1 FROM c""")
def metric_prf(spark, sf_dir):
    rows = _guesses(spark, sf_dir)
    found = metrics.id_sets(rows.where("guess = 0"), rows.where("quality = 0"), "doc_id")
    return found.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {SQL_GUESSES}, k AS (SELECT unnest([0, 1]) AS c), s AS (SELECT c, 2.0 * sum((quality = c AND guess = c)::INT) / (sum((quality = c)::INT) + sum((guess = c)::INT)) AS f FROM g, k GROUP BY c)
           SELECT round(avg(f), 6) AS macro_f1 FROM s""")
def metric_macro_f1(spark, sf_dir):
    return metrics.macro_f1(_guesses(spark, sf_dir), "quality", "guess").select(F.round("macro_f1", 6).alias("macro_f1"))


@query("""WITH n AS (SELECT lang AS a, source AS b, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM n),
          x AS (SELECT sum(m * (m - 1) / 2) AS x FROM (SELECT sum(n) AS m FROM n GROUP BY a)), y AS (SELECT sum(m * (m - 1) / 2) AS y FROM (SELECT sum(n) AS m FROM n GROUP BY b))
          SELECT round((s - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 6) AS ari FROM s, x, y""")
def metric_ari(spark, sf_dir):
    return metrics.adjusted_rand(Tables(spark, sf_dir).documents, "lang", "source").select(F.round("ari", 6).alias("ari"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS x,
          rank() OVER (ORDER BY source) + (count(*) OVER (PARTITION BY source) - 1) / 2.0 AS y FROM documents) SELECT round(corr(x, y), 6) AS spearman FROM r""")
def metric_spearman(spark, sf_dir):
    return metrics.spearman(Tables(spark, sf_dir).documents, "n_chars", "source").select(F.round("spearman", 6).alias("spearman"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS history, count(*) AS turns FROM conversations GROUP BY 1")
def chat_history(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    said = F.transform(turns, lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.array_join(said, "\n\n").alias("history"), F.count(F.lit(1)).alias("turns"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""")
def html_pages_parse(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")
    )


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def win_tumbling(spark, sf_dir):
    found = windows.tumbling(Tables(spark, sf_dir).events, "1 day", ["event_type"])
    return found.select(F.col("start").cast("timestamp_ntz").cast("date").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
          s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
          SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def win_session(spark, sf_dir):
    return windows.sessions(Tables(spark, sf_dir).events, "6 hours", ["user_id"]).select("user_id", "n")


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
          s AS (SELECT user_id, ts, value, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
          SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 7 HOUR <= (SELECT max(ts) FROM events)""")
def stream_sessions(spark, sf_dir):
    """Sessions of the events as a stream, by state and timers: those whose end the watermark (an hour) has passed."""
    source, out, checkpoint = (new_path(spark, x) for x in ("events", "sessions", "progress"))
    events = Tables(spark, sf_dir).events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.write.parquet(source)
    stream = state.timed_sessions(windows.read_stream(spark, source, events.schema, 1000), 6 * 3600_000, ["user_id"])
    windows.run_once(stream, out, checkpoint)
    return spark.read.schema("user_id long, n long, total double").parquet(out).select("user_id", "n", F.round("total", 2).alias("total"))


def stand_in(prompts: list[str]) -> list[str]:
    """Replies in the form of a model's, by fixed rules over the record in each prompt."""
    replies = []
    for prompt in prompts:
        task, _, record = prompt.partition("\n")
        r = json.loads(record)
        if "mentions a license" in task:
            replies.append(f"```text\n{'TRUE' if 'license' in r['text'].lower() else 'FALSE'}\n```")
        elif "both of even or both of odd length" in task:
            replies.append(str(len(r["n_name"]) % 2 == len(r["r_name"]) % 2))
        elif "long words" in task:
            replies.append(json.dumps([{"word": w, "letters": str(len(w))} for w in re.findall("[a-z]{9,}", r["text"])]))
        elif "kind" in task:
            replies.append("Here it is: " + json.dumps({"kind": "question" if "?" in r["text"] else "statement", "lines": str(r["text"].count("\n") + 1)}))
        else:
            rows = [json.loads(x) for x in json.loads(r["records"])]
            rows = [x.get("doc", x) for x in rows]
            replies.append(json.dumps({"total": sum(int(x.get("s_suppkey") or x.get("n_chars") or x.get("total") or 0) for x in rows)}))
    return replies


MODEL = Judge(model=stand_in)


@query("SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%license%'")
def judged_filter(spark, sf_dir):
    docs = SemFrame(Tables(spark, sf_dir).documents, MODEL)
    return docs.sem_filter("It mentions a license.", columns=["text"]).df.select("doc_id", "lang")


KIND = [Field("kind", "string", "question or statement"), Field("lines", "bigint", "how many lines there are")]


@query("""SELECT doc_id, CASE WHEN text LIKE '%?%' THEN 'question' ELSE 'statement' END AS kind,
          CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines FROM documents""")
def judged_map(spark, sf_dir):
    return SemFrame(Tables(spark, sf_dir).documents, MODEL).sem_map(KIND, columns=["text"]).df.select("doc_id", "kind", "lines")


@query("SELECT item_id, word, CAST(length(word) AS BIGINT) AS letters FROM (SELECT item_id, unnest(regexp_extract_all(text, '[a-z]{9,}')) AS word FROM benchmark)")
def judged_flat_map(spark, sf_dir):
    items = SemFrame(Tables(spark, sf_dir).benchmark, MODEL)
    return items.sem_flat_map([Field("word"), Field("letters", "bigint")], "The long words of the text.", columns=["text"]).df.select("item_id", "word", "letters")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE length(n_name) % 2 = length(r_name) % 2")
def judged_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = SemFrame(t.nation, MODEL).sem_join(SemFrame(t.region), "The names are both of even or both of odd length.", on=[("n_regionkey", "r_regionkey")])
    return found.df.select("n_name", "r_name")


@query("SELECT CASE WHEN text LIKE '%?%' THEN 'question' ELSE 'statement' END AS kind, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY 1")
def judged_groupby(spark, sf_dir):
    docs = SemFrame(Tables(spark, sf_dir).documents, MODEL).sem_map(KIND, columns=["text"])
    found = docs.sem_groupby([Field("kind")], [("n_chars", "count", "n"), ("n_chars", "mean", "mean_chars")]).df
    return found.withColumn("mean_chars", F.round("mean_chars", 4))


@query("SELECT CAST(sum(s_suppkey) AS BIGINT) AS total FROM supplier")
def judged_aggregate(spark, sf_dir):
    rows = SemFrame(Tables(spark, sf_dir).supplier.select("s_suppkey"), MODEL)
    return rows.sem_aggregate("Add the numbers.", [Field("total", "bigint")], budget=200).df


#: Tokens of the stand-in models' context: longer prompts are an error of the library.
CONTEXT = 300


def in_context(prompts: list[str]) -> list[str]:
    """stand_in() by a model that refuses prompts over its context."""
    long = [p for p in prompts if len(p) // text.CHARS + 1 > CONTEXT]
    if long:
        raise ValueError(f"a prompt of {len(long[0])} characters")
    return stand_in(prompts)


def licenses(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: how often a text names licenses, beside a constant."""
    return [[float(t.lower().count("license")), 1.0] for t in texts]


SHORT = Judge(model=in_context, context=CONTEXT, embed=licenses)
_LONG_TASK = "Is this true of the record? It mentions a license."


@query(f"""WITH d AS (SELECT doc_id, lang, text, length(CAST(to_json(text) AS VARCHAR)) + {len('{"text":}')} AS n FROM documents),
          r AS (SELECT *, {4 * CONTEXT - 2 - len(_LONG_TASK)} AS room FROM d),
          c AS (SELECT *, CAST(4 * greatest(1, least((n // 4 + 1) // 32, (room // 4 + 1) // 10)) AS BIGINT) AS size FROM r)
          SELECT doc_id, lang FROM c WHERE CASE WHEN n <= room THEN lower(text) LIKE '%license%'
            ELSE list_bool_or(list_transform(range(0, (length(text) - 1) // size + 1), lambda i: lower(substring(text, i * size + 1, size)) LIKE '%license%')) END""")
def judged_long_filter(spark, sf_dir):
    """By a model with a short context: of a longer text it sees the chunks that are most like the condition."""
    docs = SemFrame(Tables(spark, sf_dir).documents, SHORT)
    return docs.sem_filter("It mentions a license.", columns=["text"]).df.select("doc_id", "lang")


@query("SELECT lang, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY 1")
def judged_long_aggregate(spark, sf_dir):
    """Whole documents in packs, none over the context; texts of a pack's length or more are cut, numbers are not."""
    docs = SemFrame(Tables(spark, sf_dir).documents.select("lang", "n_chars", "text"), SHORT)
    docs = docs.code(lambda d: d.select("lang", F.struct("n_chars", "text").alias("doc")))
    return docs.sem_groupby([Field("lang")], [("doc", "Add the numbers.", "total", "bigint")], budget=CONTEXT).df


LETTERS = "etaoinsr"
SOUGHT = "the rain in spain stays mainly in the plain"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: how often a text has each of some letters, in either case."""
    return [[float(t.count(x) + t.count(x.upper())) for x in LETTERS] for t in texts]


_COUNTS = ", ".join(
    f"(2 * length(text) - length(replace(text, '{x}', '')) - length(replace(text, '{x.upper()}', '')))::DOUBLE / greatest(1, (length(text) - 1) // 32000 + 1)" for x in LETTERS
)
_SOUGHT = f"{letter_counts([SOUGHT])[0]}::DOUBLE[]"
SQL_LETTERS = f"v AS (SELECT doc_id, source, [{_COUNTS}] AS e FROM documents WHERE length(text) > 0)"


@query(f"""WITH {SQL_LETTERS}, c AS (SELECT source, list_distance([{", ".join(f"avg(e[{i + 1}])" for i in range(len(LETTERS)))}], {_SOUGHT}) AS d FROM v GROUP BY 1)
           SELECT doc_id, source, round(s, 6) AS score FROM (SELECT doc_id, source, coalesce(nullif(list_cosine_similarity(e, {_SOUGHT}), 'nan'::DOUBLE), 0) AS s FROM v
           WHERE source IN (SELECT source FROM c ORDER BY d, source LIMIT 2)) ORDER BY s DESC, doc_id LIMIT 10""")
def topk_text_index(spark, sf_dir):
    docs, catalog = Tables(spark, sf_dir).documents, Catalog(spark, new_path(spark, "catalog"))
    options = {"id_col": "doc_id", "text_col": "text", "model": letter_counts, "cluster_col": "source"}
    index.TextIndex.build(catalog, "documents", "letters", docs, **options)
    found = index.TextIndex.get(catalog, "documents", "letters", docs, **options)  # read from the catalog
    return SemFrame(docs).sem_search(found, SOUGHT, 10, probes=2).df.select("doc_id", F.col("cluster").alias("source"), F.round("score", 6).alias("score"))


@query(f"""WITH {SQL_LETTERS} SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, coalesce(nullif(list_cosine_similarity(e, {_SOUGHT}), 'nan'::DOUBLE), 0) AS s FROM v) ORDER BY s DESC, doc_id LIMIT 10""")
def topk_stale_rebuild(spark, sf_dir):
    docs, catalog = Tables(spark, sf_dir).documents, Catalog(spark, new_path(spark, "catalog"))
    options = {"id_col": "doc_id", "text_col": "text", "model": letter_counts, "clusters": 4}
    index.TextIndex.build(catalog, "documents", "letters", docs.where("lang = 'en'"), **options)
    found = index.TextIndex.get(catalog, "documents", "letters", docs, **options)  # of other rows, so it is built anew
    return found.search(SOUGHT, 10).select("doc_id", F.round("score", 6).alias("score"))


@query(ORACLE_SQL["topk_text_index"])
def topk_index_delta(spark, sf_dir):
    """An index of an earlier state of the documents, brought up to date: some were not there yet, some had other texts, some went."""
    docs, catalog = Tables(spark, sf_dir).documents, Catalog(spark, new_path(spark, "catalog"))
    options = {"id_col": "doc_id", "text_col": "text", "model": letter_counts, "cluster_col": "source"}
    earlier = docs.where("doc_id % 10 <> 3").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" trees"))).otherwise(F.col("text")))
    earlier = earlier.unionByName(docs.where("doc_id % 13 = 0").withColumn("doc_id", -1 - F.col("doc_id")))
    index.TextIndex.build(catalog, "documents", "letters", earlier, **options)
    found = index.TextIndex.get(catalog, "documents", "letters", docs, **options)
    return found.search(SOUGHT, 10, probes=2).select("doc_id", F.col("cluster").alias("source"), F.round("score", 6).alias("score"))


@query(ORACLE_SQL["topk_cosine"])
def topk_tree(spark, sf_dir):
    """Exact, by a tree of clusters whose bounds leave most leaves unread where vectors lie in groups."""
    rows = Tables(spark, sf_dir).embeddings
    made = tree.VectorTree.build(rows.select("vec_id", "embedding"), vector_col="embedding", id_col="vec_id", leaf=64)
    return made.search(VECTOR, 10, vector_col="embedding", id_col="vec_id").select("vec_id", F.round("score", 6).alias("score"))


def alphabetical(prompts: list[str]) -> list[str]:
    """A stand-in for a model that ranks: by the texts themselves, equal ones as they come."""
    lists = [json.loads(p.partition("\n")[2])["records"] for p in prompts]
    return [f"The ranking is {sorted(range(len(x)), key=lambda i: x[i].encode())}." for x in lists]


@query(f"""WITH {SQL_LETTERS}, c AS (SELECT doc_id, coalesce(nullif(list_cosine_similarity(e, {_SOUGHT}), 'nan'::DOUBLE), 0) AS s FROM v ORDER BY s DESC, doc_id LIMIT 60)
           SELECT doc_id, CAST(row_number() OVER (ORDER BY text, s DESC, doc_id) AS INT) AS rank FROM c JOIN documents USING (doc_id) ORDER BY rank LIMIT 5""")
def topk_judged(spark, sf_dir):
    """The nearest 60 texts, of which a model that ranks lists of 12 picks five."""
    docs, catalog = Tables(spark, sf_dir).documents, Catalog(spark, new_path(spark, "catalog"))
    made = index.TextIndex.build(catalog, "documents", "letters", docs, id_col="doc_id", text_col="text", model=letter_counts, cluster_col="source")
    near = made.search(SOUGHT, 60)
    return topk.judged_topk(near, "The first by the alphabet.", 5, Judge(model=alphabetical), text_col="text", id_col="doc_id", size=12).select("doc_id", "rank")


@query("""SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
          FROM embeddings a JOIN embeddings b ON a.label < 5 AND b.label >= 5 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def embedding_join(spark, sf_dir):
    rows = Tables(spark, sf_dir).embeddings
    left = rows.where("label < 5").select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("left_vector"))
    right = rows.where("label >= 5").select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("right_vector"))
    found = joins.embedding_join(left, right, "left_vector", "right_vector", 0.3, vectors=False)
    return found.select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("SELECT p_partkey AS id, split_part(p_type, ' ', 1) AS kind, p_size AS size FROM part WHERE split_part(p_type, ' ', 1) = 'STANDARD' OR p_size > 45")
def nested_access(spark, sf_dir):
    parts = Tables(spark, sf_dir).part.select(
        F.col("p_partkey").alias("id"), F.struct(F.struct(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("value")).alias("kind"), F.col("p_size").alias("size")).alias("about")
    )
    return parts.where((F.col("about.kind.value") == "STANDARD") | (F.col("about.size") > 45)).select("id", F.col("about.kind.value").alias("kind"), F.col("about.size").alias("size"))


@query("""SELECT a.s_suppkey || '-' || b.s_suppkey AS pair FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey
          AND floor(a.s_acctbal / 5000) = floor(b.s_acctbal / 5000) AND a.s_suppkey < b.s_suppkey""")
def self_join_pairs_concat(spark, sf_dir):
    rows = Tables(spark, sf_dir).supplier.withColumn("band", F.floor(F.col("s_acctbal") / 5000))
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))
    return a.join(b, on).select(F.concat_ws("-", "a.s_suppkey", "b.s_suppkey").alias("pair"))


@query("SELECT p_partkey, p_name FROM part WHERE length(p_name) BETWEEN 8 AND 12 AND p_size NOT IN (1, 2, 3)")
def string_length(spark, sf_dir):
    return Tables(spark, sf_dir).part.where(F.length("p_name").between(8, 12) & ~F.col("p_size").isin(1, 2, 3)).select("p_partkey", "p_name")


@query("SELECT o_orderpriority, round(2026 - avg(year(o_orderdate)), 6) AS mean_age FROM orders GROUP BY 1")
def mean_arithmetic(spark, sf_dir):
    return Tables(spark, sf_dir).orders.groupBy("o_orderpriority").agg(F.round(F.lit(2026) - F.avg(F.year("o_orderdate")), 6).alias("mean_age"))


@query("""WITH a AS (SELECT o_custkey AS k, bool_or(o_totalprice > 300000) AS large FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal < 0 AS debt FROM customer WHERE c_nationkey < 12)
          SELECT k AS custkey FROM a FULL JOIN b USING (k) WHERE (coalesce(large, false) OR coalesce(debt, false)) AND (NOT coalesce(large, true) OR NOT coalesce(debt, true))""")
def exclusive_sides(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.bool_or(F.col("o_totalprice") > 300000).alias("large"))
    b = t.customer.where("c_nationkey < 12").select(F.col("c_custkey").alias("custkey"), (F.col("c_acctbal") < 0).alias("debt"))
    some = F.coalesce("large", F.lit(False)) | F.coalesce("debt", F.lit(False))
    other = ~F.coalesce("large", F.lit(True)) | ~F.coalesce("debt", F.lit(True))
    return a.join(b, "custkey", "outer").where(some & other).select("custkey")


SQL_VALUES = "SELECT CASE WHEN s_acctbal < {0} THEN NULL ELSE s_nationkey END AS v FROM supplier WHERE s_acctbal < 3000"


@query(f"""SELECT c_custkey, CAST(1 AS INT) AS list FROM customer WHERE c_nationkey NOT IN ({SQL_VALUES.format(-99999)})
           UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_nationkey NOT IN ({SQL_VALUES.format(0)})
           UNION ALL SELECT c_custkey, 3 FROM customer WHERE nullif(c_nationkey, 5) NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 1e9)""")
def not_in_nulls(spark, sf_dir):
    t = Tables(spark, sf_dir)
    some = t.supplier.where("s_acctbal < 3000")
    lists = [(1, some.select(F.col("s_nationkey").alias("v"))), (2, some.select(F.expr("CASE WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END").alias("v"))), (3, t.supplier.where("s_acctbal > 1e9").select(F.col("s_nationkey").alias("v")))]
    customers = t.customer.select("c_custkey", F.expr("nullif(c_nationkey, 5)").alias("gaps"), "c_nationkey")
    found = [relational.not_in(customers, "gaps" if n == 3 else "c_nationkey", values, "v").select("c_custkey", F.lit(n).alias("list")) for n, values in lists]
    return relational.union_ragged(found)


@query("""SELECT r AS band, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN (SELECT unnest(range(0, 50)) AS r)
          ON o_totalprice >= r * 10000 AND o_totalprice < r * 10000 + 15000 GROUP BY 1""")
def range_join(spark, sf_dir):
    bands = spark.range(50).select(F.col("id").alias("band"), (F.col("id") * 10000).alias("a"), (F.col("id") * 10000 + 15000).alias("b"))
    met = relational.range_join(Tables(spark, sf_dir).orders.select("o_totalprice"), bands, "o_totalprice", "a", "b", 10000)
    return met.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a FROM orders)
          SELECT x.k AS custkey, x.id AS one, y.id AS other FROM o x JOIN o y ON x.k = y.k AND x.id < y.id AND x.a < y.a + 30 AND y.a < x.a + 30""")
def interval_join(spark, sf_dir):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    rows = Tables(spark, sf_dir).orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("one"), day.alias("a"), (day + 30).alias("b"))
    other = rows.select("custkey", F.col("one").alias("other"), F.col("a").alias("c"), F.col("b").alias("d"))
    return relational.interval_join(rows, other, ("a", "b"), ("c", "d"), 30, on=["custkey"]).where("one < other").select("custkey", "one", "other")


@query("""SELECT a.event_id, arg_max(b.event_id, (b.ts, b.event_id)) AS before FROM (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)) a
          LEFT JOIN (SELECT * FROM events WHERE event_type = (SELECT max(event_type) FROM events)) b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY 1""")
def asof_join(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    ends = events.agg(F.min("event_type").alias("a"), F.max("event_type").alias("z"))  # one row
    side = lambda x: events.join(F.broadcast(ends), F.col("event_type") == F.col(x)).select("user_id", "ts", "event_id")
    return relational.asof_join(side("a"), side("z"), ["user_id"], "ts", "event_id", "before").select("event_id", "before")


@query("SELECT l_returnflag, true AS distinct_near, true AS median_near FROM lineitem GROUP BY 1")
def approx_aggregates(spark, sf_dir):
    """Whether the approximate aggregates lie within their error of the exact ones."""
    items = Tables(spark, sf_dir).lineitem
    near = relational.approximate(items, ["l_returnflag"], "l_partkey", error=0.02, shares=(0.5,))
    exact = items.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n"), F.count(F.lit(1)).alias("rows"))
    rank = items.join(near, "l_returnflag").groupBy("l_returnflag").agg(F.count_if(F.col("l_partkey") <= F.col("percentiles")[0]).alias("below"))
    return near.join(exact, "l_returnflag").join(rank, "l_returnflag").select(
        "l_returnflag", (F.abs(F.col("distinct_values") / F.col("n") - 1) < 0.08).alias("distinct_near"), (F.abs(F.col("below") / F.col("rows") - 0.5) < 0.05).alias("median_near"),
    )


@query(f"""WITH {SQL_GUESSES}, a AS (SELECT lang, guess AS q, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT lang, quality AS q, count(*) AS n FROM g GROUP BY ALL),
           h AS (SELECT sum(least(a.n, b.n)) AS h FROM a JOIN b USING (lang, q)), s AS (SELECT count(*) AS n FROM g)
           SELECT round(h / n, 6) AS precision, round(h / n, 6) AS recall, round(h / n, 6) AS f1 FROM h, s""")
def metric_rows(spark, sf_dir):
    rows = _guesses(spark, sf_dir)
    found = metrics.metric("rows", rows.select("lang", F.col("guess").alias("q")), rows.select("lang", F.col("quality").alias("q")))
    return found.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""SELECT lang, source, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(doc_id) AS BIGINT) AS ids
          FROM documents WHERE lang <> 'en' GROUP BY 1, 2""")
def scan_documents(spark, sf_dir):
    """The documents as files of JSON lines, one folder a language, read back by ranges; only wanted files are opened."""
    path = new_path(spark, "files")
    Tables(spark, sf_dir).documents.select("doc_id", "text", "lang", "source").write.partitionBy("lang").json(path)
    langs = [r[0] for r in Tables(spark, sf_dir).documents.select("lang").where("lang <> 'en'").distinct().collect()]  # a few folders
    files = reduce(DataFrame.unionByName, [scan.scan(spark, path, suffixes="json", under=f"lang={x}/", rangeBytes=str(1 << 20)) for x in langs])
    lines = files.select(F.regexp_extract("uri", "lang=([^/]*)/", 1).alias("lang"), F.explode(F.split("contents", "\n")).alias("line")).where("line <> ''")
    rows = lines.select("lang", F.from_json("line", "doc_id long, text string, source string").alias("d")).select("lang", "d.*")
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("doc_id").alias("ids"))


@query(ORACLE_SQL["chunk_text"])
def sql_chunks_lateral(spark, sf_dir):
    table_functions.register_chunks(spark)
    return spark.sql("SELECT d.doc_id, c.position, c.chunk FROM {docs} AS d, LATERAL chunks(d.text, 500) AS c", docs=Tables(spark, sf_dir).documents)


@query(ORACLE_SQL["judged_flat_map"])
def sql_judged_flat_map(spark, sf_dir):
    table_functions.register_flat_map(spark, "long_words", MODEL, [Field("word"), Field("letters")], "The long words of the text.")
    found = "SELECT CAST(key AS BIGINT) AS item_id, word, CAST(letters AS BIGINT) AS letters FROM long_words(TABLE(SELECT item_id, text FROM {items})) WHERE error IS NULL"
    return spark.sql(found, items=Tables(spark, sf_dir).benchmark)


@query("""WITH r(first, last) AS (VALUES (0, 7), (3, 17), (0, 31), (29, 31)), e AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events)
          SELECT CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, count(*) AS n, count(DISTINCT user_id) AS users, 0.0::DOUBLE AS hll_error, 0.0::DOUBLE AS median_rank_error
          FROM r JOIN e ON d >= first AND d < last GROUP BY 1, 2""")
def approx_merged(spark, sf_dir):
    """Sketches of each day, stored and merged over ranges of days: users (by theta sketches in parts of up to 4,096 users, so exactly), the
    share by which HLL is off beyond 3 standard errors, and by how much the median's rank is off beyond 2 per cent."""
    events = Tables(spark, sf_dir).events.withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long"))
    path = new_path(spark, "sketches")
    sketches.sketched(events, ["day"], "user_id", "value").write.parquet(path)
    ranges = spark.createDataFrame([(0, 7), (3, 17), (0, 31), (29, 31)], "first long, last long")
    days = relational.range_join(spark.read.parquet(path), ranges, "day", "first", "last", 10)
    found = sketches.estimates(sketches.merged(days, ["first", "last"]))
    users = sketches.counts(relational.range_join(sketches.parted(events, ["day"], "user_id"), ranges, "day", "first", "last", 10), ["first", "last"])
    exact = relational.range_join(events.select("day", "user_id", "value"), ranges, "day", "first", "last", 10).join(found.select("first", "last", F.col("quantiles")[0].alias("m")), ["first", "last"])
    exact = exact.groupBy("first", "last").agg(F.countDistinct("user_id").alias("e"), F.avg((F.col("value") <= F.col("m")).cast("double")).alias("rank"), F.avg((F.col("value") < F.col("m")).cast("double")).alias("under"))
    off = F.greatest(F.lit(0.0), F.abs(F.col("distinct_hll") / F.col("e") - 1) - 3 * 1.04 / 64)
    median = F.greatest(F.lit(0.0), F.greatest(F.lit(0.5) - F.col("rank"), F.col("under") - 0.5) - 0.02)
    found = found.join(exact, ["first", "last"]).join(users, ["first", "last"], "left")
    return found.select("first", "last", "n", F.coalesce("distinct_values", F.lit(0).cast("long")).alias("users"), off.alias("hll_error"), median.alias("median_rank_error"))


@query("""SELECT event_type, count(*) AS n, CAST(sum((props->>'$.k')::INT) AS BIGINT) AS k, CAST(0 AS BIGINT) AS missing, 'OBJECT<k: BIGINT>' AS shape FROM events GROUP BY 1""")
def variant_facts(spark, sf_dir):
    """The events' properties as variants: parsed once, a fact that they have, one that they have not, and their type."""
    events = variants.facts(variants.parsed(Tables(spark, sf_dir).events, "props"), "variant", {"k": ("$.k", "int"), "gone": ("$.gone[0].x", "string")})
    found = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.count("gone").alias("missing"))
    return found.join(variants.shape(events, "variant", ["event_type"]), "event_type")


@query("""WITH r AS (SELECT c_custkey AS k, c_nationkey AS x, floor(c_acctbal / 100) AS y FROM customer),
          p AS (SELECT sign(a.x - b.x) AS s, sign(a.y - b.y) AS t FROM r a JOIN r b ON a.k < b.k)
          SELECT round(sum(s * t) / sqrt(sum(abs(s)) * sum(abs(t))), 9) AS kendall FROM p""")
def metric_kendall(spark, sf_dir):
    rows = Tables(spark, sf_dir).customer.select("c_nationkey", F.floor(F.col("c_acctbal") / 100).alias("y"))
    return metrics.metric("kendall", rows, "c_nationkey", "y").select(F.round("kendall", 9).alias("kendall"))


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS c FROM customer UNION SELECT c_custkey, 'n' || c_nationkey FROM customer WHERE c_acctbal > 2000),
          b AS (SELECT c_custkey AS k, 'n' || c_nationkey AS c FROM customer WHERE c_acctbal > 1000 UNION SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 > 0),
          m AS (SELECT c_custkey AS k FROM customer), p AS (SELECT x.k AS k, y.k AS l FROM m x JOIN m y ON x.k < y.k),
          s AS (SELECT x.k, y.k AS l, count(*) AS n FROM a x JOIN a y USING (c) WHERE x.k < y.k GROUP BY 1, 2), t AS (SELECT x.k, y.k AS l, count(*) AS n FROM b x JOIN b y USING (c) WHERE x.k < y.k GROUP BY 1, 2),
          c AS (SELECT coalesce(s.n, 0) AS i, coalesce(t.n, 0) AS j, count(*)::DOUBLE AS w FROM p LEFT JOIN s USING (k, l) LEFT JOIN t USING (k, l) GROUP BY 1, 2),
          e AS (SELECT sum(x.w * y.w) AS e FROM (SELECT i, sum(w) AS w FROM c GROUP BY 1) x JOIN (SELECT j AS i, sum(w) AS w FROM c GROUP BY 1) y USING (i)),
          o AS (SELECT sum(w) FILTER (i = j) AS o, sum(w) AS n FROM c) SELECT round((o / n - e / n / n) / (1 - e / n / n), 9) AS omega FROM o, e""")
def metric_omega(spark, sf_dir):
    """Customers in one or more clusters: of their segment, and of their nation if their balance is high."""
    rows = Tables(spark, sf_dir).customer
    segment, nation = rows.select("c_custkey", F.col("c_mktsegment").alias("c")), rows.select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("c"), "c_acctbal")
    a = segment.unionByName(nation.where("c_acctbal > 2000").drop("c_acctbal"))
    b = nation.where("c_acctbal > 1000").drop("c_acctbal").unionByName(segment.where("c_custkey % 3 > 0"))
    # customers in no cluster are items too
    b = b.unionByName(rows.select("c_custkey", F.lit(None).cast("string").alias("c")))
    return metrics.metric("omega_overlap", a, b, "c_custkey", "c").select(F.round("omega", 9).alias("omega"))


@query("""SELECT round(avg(abs(l_extendedprice - l_quantity * 1000)), 4) AS mae, round(100 * avg(abs(l_extendedprice - l_quantity * 1000) / abs(l_extendedprice)), 6) AS mape FROM lineitem""")
def metric_mape(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.withColumn("guess", F.col("l_quantity") * 1000)
    return metrics.metric("mape", rows, "guess", "l_extendedprice").select(F.round("mae", 4).alias("mae"), F.round("mape", 6).alias("mape"))
