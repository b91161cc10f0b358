"""Views that read the star-schema test tables as graph, blocks, mentions, questions and vectors.

The view texts are plain SQL and hold for Spark (``spark.sql`` with DataFrame arguments) and for
the checking engine alike; they only rename and reshape columns. No view filters by id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEW_SQL = {
    "g_edges": """
SELECT DISTINCT 'exp_' || CAST(l_orderkey AS STRING) AS source, 'mat_' || CAST(l_partkey AS STRING) AS target, 'USES_MATERIAL' AS type FROM {lineitem}
UNION ALL SELECT DISTINCT 'exp_' || CAST(l_orderkey AS STRING), 'eq_' || CAST(l_suppkey AS STRING), 'ON_EQUIPMENT' FROM {lineitem}
UNION ALL SELECT DISTINCT 'exp_' || CAST(l_orderkey AS STRING), 'proc_' || p_type, 'USES_PROCESS' FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
UNION ALL SELECT DISTINCT 'exp_' || CAST(l_orderkey AS STRING), 'prop_' || l_returnflag || l_linestatus, 'MEASURES_PROPERTY' FROM {lineitem}
UNION ALL SELECT 'exp_' || CAST(o_orderkey AS STRING), 'cond_' || o_orderpriority, 'AT_CONDITION' FROM {orders}
UNION ALL SELECT 'exp_' || CAST(o_orderkey AS STRING), 'fac_' || CAST(c_nationkey AS STRING), 'AT_FACILITY' FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL SELECT 'exp_' || CAST(o_orderkey AS STRING), 'team_' || c_mktsegment, 'CONDUCTED_BY' FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL SELECT 'pub_' || CAST(doc_id AS STRING), 'exp_' || CAST(o_orderkey AS STRING), 'DESCRIBES_EXPERIMENT' FROM {documents} JOIN {orders} ON doc_id = o_orderkey
UNION ALL SELECT 'pub_' || CAST(doc_id AS STRING), 'topic_' || source, 'TAGGED_AS' FROM {documents}
UNION ALL SELECT 'pub_' || CAST(doc_id AS STRING), 'expert_' || CAST(o_custkey AS STRING), 'AUTHORED_BY' FROM {documents} JOIN {orders} ON doc_id = o_orderkey
UNION ALL SELECT 'expert_' || CAST(c_custkey AS STRING), 'team_' || c_mktsegment, 'MEMBER_OF' FROM {customer}
UNION ALL SELECT 'exp_' || CAST(o_orderkey AS STRING), 'concl_' || CAST(doc_id AS STRING), 'PRODUCES_CONCLUSION' FROM {documents} JOIN {orders} ON doc_id = o_orderkey
UNION ALL SELECT 'concl_' || CAST(doc_id AS STRING), 'pub_' || CAST(doc_id AS STRING), 'VALIDATED_BY' FROM {documents} JOIN {orders} ON doc_id = o_orderkey
UNION ALL SELECT 'concl_' || CAST(a.doc_id AS STRING), 'concl_' || CAST(b.doc_id AS STRING), 'CONTRADICTS' FROM {labels} a JOIN {labels} b ON b.doc_id = a.doc_id + 1 WHERE a.quality <> b.quality
""",
    "g_nodes": """
SELECT 'exp_' || CAST(o_orderkey AS STRING) AS id, 'experiment' AS type, 'Order ' || CAST(o_orderkey AS STRING) AS name, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date, CASE WHEN n_regionkey = 3 THEN 'EU' ELSE 'INTL' END AS country, o_totalprice AS price_musd, d.avg_discount AS discount_pct
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey LEFT JOIN (SELECT l_orderkey, ROUND(100 * AVG(l_discount), 4) AS avg_discount FROM {lineitem} GROUP BY l_orderkey) d ON d.l_orderkey = o_orderkey
UNION ALL SELECT 'mat_' || CAST(p_partkey AS STRING), 'material', p_name, NULL, NULL, NULL, NULL FROM {part}
UNION ALL SELECT DISTINCT 'proc_' || p_type, 'process', p_type, NULL, NULL, NULL, NULL FROM {part}
UNION ALL SELECT DISTINCT 'cond_' || o_orderpriority, 'condition', o_orderpriority, NULL, NULL, NULL, NULL FROM {orders}
UNION ALL SELECT 'eq_' || CAST(s_suppkey AS STRING), 'equipment', s_name, NULL, NULL, NULL, NULL FROM {supplier}
UNION ALL SELECT 'fac_' || CAST(n_nationkey AS STRING), 'facility', n_name, NULL, CASE WHEN n_regionkey = 3 THEN 'EU' ELSE 'INTL' END, NULL, NULL FROM {nation}
UNION ALL SELECT DISTINCT 'prop_' || l_returnflag || l_linestatus, 'property', 'flag ' || l_returnflag || l_linestatus, NULL, NULL, NULL, NULL FROM {lineitem}
UNION ALL SELECT DISTINCT 'team_' || c_mktsegment, 'team', c_mktsegment, NULL, NULL, NULL, NULL FROM {customer}
UNION ALL SELECT 'expert_' || CAST(c_custkey AS STRING), 'expert', c_name, NULL, NULL, NULL, NULL FROM {customer}
UNION ALL SELECT DISTINCT 'topic_' || source, 'topic', source, NULL, NULL, NULL, NULL FROM {documents}
UNION ALL SELECT 'pub_' || CAST(doc_id AS STRING), 'publication', 'Document ' || CAST(doc_id AS STRING), NULL, NULL, NULL, NULL FROM {documents}
UNION ALL SELECT 'concl_' || CAST(doc_id AS STRING), 'conclusion', split_part(text, chr(10), 1), NULL, NULL, NULL, NULL FROM {documents} JOIN {orders} ON doc_id = o_orderkey
""",
    # One row per distinct question text: equal questions are answered once.
    "q_text": """
SELECT MIN(p_partkey) AS question_id, text FROM (
  SELECT p_partkey, 'Which tests of ' || p_name || ' in Europe have discount <= ' || CAST(p_partkey % 10 AS STRING) || ' over the last ' || CAST(1 + p_partkey % 5 AS STRING) || ' years' AS text FROM {part}) q
GROUP BY text
""",
    "mentions": """
SELECT l_orderkey AS doc_id, CAST(0 AS BIGINT) AS chunk_no, CAST(l_linenumber AS BIGINT) AS ord, l_orderkey * 8 + l_linenumber AS pos,
  'e' || CAST(l_linenumber AS STRING) AS tmp_id, 'material' AS type,
  CASE WHEN l_linenumber % 3 = 0 THEN p_name || 's' WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS name,
  ROUND(100 * l_discount, 2) AS discount_pct, 'src' || CAST(l_orderkey % 20 AS STRING) AS source_file
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
""",
    "attach_log": """
SELECT user_id AS doc_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'activate' WHEN 'click' THEN 'detach_auto' WHEN 'purchase' THEN 'attach_manual' WHEN 'error' THEN 'delete' ELSE 'noop' END AS action, ts FROM {events}
""",
    "eval_items": """
SELECT doc_id AS item_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(1 + quality * 2 + doc_id % 3 AS BIGINT) END AS rating, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality = 1 END AS retrieval_ok, toxic = 0 AS factual_ok, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE toxic = quality END AS citation_ok, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE 'gold ' || CAST(doc_id AS STRING) END AS gold_answer FROM {labels}
""",
    "external_sources": """
SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'scholar' ELSE 'patent' END AS kind, text AS title, text AS snippet, 1990 + item_id % 35 AS year FROM {benchmark}
""",
    "chunk_vectors": """
SELECT vec_id AS chunk_id, CAST(floor(vec_id / 4) AS BIGINT) AS doc_id, vec_id % 4 AS chunk_no, embedding FROM {embeddings}
""",
}

# Spelled differently in the two engines.
BLOCKS_CHECK_SQL = """
SELECT doc_id, pos - 1 AS ord, 'para ' || CAST(pos - 1 AS STRING) AS location, CASE WHEN contains(line, ' | ') THEN 'table' ELSE 'paragraph' END AS kind, trim(line) AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(line) <> ''
"""
FILES_CHECK_SQL = """
SELECT doc_id, 'raw/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path, n_chars AS size, sha256(text) AS sha256, text FROM documents
"""
QUERY_VECTORS_CHECK_SQL = """
SELECT qset_id, variant_no, pos, m / sqrt(sum(m * m) OVER (PARTITION BY qset_id, variant_no)) AS v FROM (
  SELECT CAST(label AS BIGINT) AS qset_id, vec_id % 3 AS variant_no, pos, avg(CAST(x AS DOUBLE)) AS m
  FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, vec_id % 3, pos)
"""

# The same edges: keys are made distinct before they become texts, so the shuffles carry numbers.
EDGES_SPARK_SQL = """
SELECT 'exp_' || CAST(l_orderkey AS STRING) AS source, 'mat_' || CAST(l_partkey AS STRING) AS target, 'USES_MATERIAL' AS type FROM (SELECT DISTINCT l_orderkey, l_partkey FROM {lineitem})
UNION ALL SELECT 'exp_' || CAST(l_orderkey AS STRING), 'eq_' || CAST(l_suppkey AS STRING), 'ON_EQUIPMENT' FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM {lineitem})
UNION ALL SELECT 'exp_' || CAST(l_orderkey AS STRING), 'proc_' || p_type, 'USES_PROCESS' FROM (SELECT DISTINCT l_orderkey, p_type FROM {lineitem} JOIN {part} ON l_partkey = p_partkey)
UNION ALL SELECT 'exp_' || CAST(l_orderkey AS STRING), 'prop_' || flags, 'MEASURES_PROPERTY' FROM (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS flags FROM {lineitem})
""" + "".join(VIEW_SQL["g_edges"].splitlines(keepends=True)[5:])
# Nodes without the averaged discount, which takes a pass over all order lines.
NODE_NAMES_SPARK_SQL = re.sub(r" LEFT JOIN \(SELECT l_orderkey.*\) d ON d\.l_orderkey = o_orderkey", "", VIEW_SQL["g_nodes"]).replace("d.avg_discount AS", "NULL AS")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _read(spark, sf_dir, VIEW_SQL[name])


def _read(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def check_view(name: str) -> str:
    """The view text for the checking engine."""
    fixed = {"blocks": BLOCKS_CHECK_SQL, "files": FILES_CHECK_SQL, "query_vectors": QUERY_VECTORS_CHECK_SQL}
    if name in fixed:
        return fixed[name].strip()
    return VIEW_SQL[name].format(**{t: t for t in TABLES}).strip()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, EDGES_SPARK_SQL)


def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, name, date, country, price_musd): nodes for readers that do not ask for the discount."""
    return _read(spark, sf_dir, NODE_NAMES_SPARK_SQL).drop("discount_pct")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the numeric attributes both as promoted columns and as the open attribute map."""
    attrs = F.map_filter(
        F.create_map(
            F.lit("price_musd"), F.col("price_musd").cast("double"), F.lit("discount_pct"), F.col("discount_pct").cast("double")
        ),
        lambda k, v: v.isNotNull(),
    )
    return view(spark, sf_dir, "g_nodes").withColumn("attrs_num", attrs)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("raw/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("sha256"),
        "text",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "q_text")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three query formulations per label: normalised mean vectors of a third of its rows each."""
    emb = table(spark, sf_dir, "embeddings")
    means = (
        emb.select(F.col("label").cast("long").alias("qset_id"), (F.col("vec_id") % 3).alias("variant_no"), F.posexplode("embedding"))
        .groupBy("qset_id", "variant_no", "pos")
        .agg(F.avg(F.col("col").cast("double")).alias("m"))
    )
    # One array element per dimension: the group is as wide as the vector, not as the data.
    vectors = means.groupBy("qset_id", "variant_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean")
    )
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda acc, x: acc + x * x))
    return vectors.select("qset_id", "variant_no", F.transform("mean", lambda x: x / norm).alias("embedding"))
