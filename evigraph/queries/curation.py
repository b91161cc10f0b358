"""Curation queries (C rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions.text import stable_id
from evigraph.operators import curation as C
from evigraph.queries.registry import query
from evigraph.queries.text import MATCH, name_words_sql
from evigraph.sources.star import edges, node_names, nodes, table, view
from evigraph.session import cut_lineage


def mentions(spark, d):
    return view(spark, d, "mentions").withColumn("attrs_num", F.create_map(F.lit("discount_pct"), F.col("discount_pct")))


def by_name(spark, d):
    """Mentions with an entity per folded name."""
    return mentions(spark, d).withColumn("entity_id", stable_id(F.col("type"), F.col("name")))


ALIASES = "al AS (SELECT lower(trim(name)) AS lname, min(id) AS node_id FROM g_nodes WHERE type = 'material' GROUP BY 1)"
SIM = "(len(list_filter({wb}, lambda x: len(list_filter({wa}, lambda y: " + MATCH.format(a="x", b="y") + ")) > 0)) / len({wb}))"


@query(
    "resolve_exact", "mentions g_nodes",
    f"WITH {ALIASES} SELECT doc_id, ord, name, node_id, count(*) AS n FROM mentions LEFT JOIN al ON lname = lower(trim(name)) GROUP BY 1, 2, 3, 4",
)
def _(spark, d):
    aliases = C.alias_table(nodes(spark, d).filter("type = 'material'"))
    return C.resolve_exact(mentions(spark, d), aliases).groupBy("doc_id", "ord", "name", "node_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "resolve_fuzzy", "mentions g_nodes",
    f"""WITH {ALIASES},
    nw AS (SELECT DISTINCT lower(trim(name)) AS lname FROM mentions WHERE lower(trim(name)) NOT IN (SELECT lname FROM al)),
    p AS (SELECT nw.lname, node_id, {SIM.format(wb=name_words_sql('nw.lname'), wa=name_words_sql('al.lname'))} AS score FROM nw, al)
    SELECT 'material' AS type, lname, arg_min(node_id, (-score, node_id)) AS node_id, round(max(score), 4) AS score FROM p WHERE score >= 0.75 GROUP BY lname""",
)
def _(spark, d):
    aliases = cut_lineage(C.alias_table(nodes(spark, d).filter("type = 'material'")))
    names = mentions(spark, d).select("type", C.folded(F.col("name")).alias("lname"))
    return C.resolve_fuzzy(names, aliases).withColumn("score", F.round("score", 4))


RESOLVED = f"""fp AS (SELECT lower(trim(name)) AS lname, min(pos) AS pos FROM mentions GROUP BY 1),
    nb AS (SELECT *, row_number() OVER (ORDER BY pos, lname) AS i, {name_words_sql('lname')} AS w FROM fp),
    ps AS MATERIALIZED (SELECT b.lname AS b, a.lname AS a, {SIM.format(wb='b.w', wa='a.w')} AS score FROM nb b JOIN nb a ON a.lname <> b.lname),
    pl AS (SELECT b, list(a) AS sim FROM ps WHERE score >= 0.75 GROUP BY b),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS lead
      UNION ALL SELECT nb.i, CASE WHEN len(list_intersect(coalesce(sim, []), lead)) > 0 THEN lead ELSE list_append(lead, nb.lname) END
      FROM walk JOIN nb ON nb.i = walk.i + 1 LEFT JOIN pl ON pl.b = nb.lname),
    ld AS (SELECT unnest(lead) AS leader FROM (SELECT lead FROM walk ORDER BY i DESC LIMIT 1)),
    lp AS (SELECT leader, pos, lname FROM ld JOIN fp ON lname = leader),
    mp AS (SELECT DISTINCT pos, lower(trim(name)) AS lname FROM mentions),
    cand AS (SELECT mp.pos, mp.lname, leader, CASE WHEN leader = mp.lname THEN 2.0 ELSE score END AS score, lp.pos AS lpos
      FROM mp JOIN lp ON (lp.pos, leader) <= (mp.pos, mp.lname) LEFT JOIN ps ON b = mp.lname AND a = leader WHERE leader = mp.lname OR score >= 0.75),
    res AS (SELECT pos, lname, arg_min(leader, (-score, lpos, leader)) AS leader FROM cand GROUP BY pos, lname)"""


@query("resolve_batch", "mentions", f"WITH {RESOLVED} SELECT pos, lname, leader, 'material_' || left(sha1(leader), 16) AS entity_id FROM res")
def _(spark, d):
    return C.resolve_batch(mentions(spark, d)).select("pos", "lname", "leader", "entity_id").distinct()


@query(
    "pipeline_stats", "mentions",
    f"""WITH {RESOLVED},
    m AS (SELECT doc_id, leader, row_number() OVER (PARTITION BY leader ORDER BY m.pos, res.lname) AS k FROM mentions m JOIN res ON res.pos = m.pos AND res.lname = lower(trim(m.name)))
    SELECT doc_id, count(*) FILTER (WHERE k = 1) AS created, count(*) FILTER (WHERE k > 1) AS reused FROM m GROUP BY doc_id""",
)
def _(spark, d):
    return C.pipeline_stats(cut_lineage(C.resolve_batch(mentions(spark, d)).select("type", "leader", "lname", "pos", "doc_id")))


@query(
    "resolve_relation_endpoints", "mentions",
    """WITH e AS (SELECT doc_id, chunk_no, tmp_id, max((ord, 'material_' || left(sha1(lower(trim(name))), 16)))[2] AS real FROM mentions GROUP BY 1, 2, 3),
    r AS (SELECT DISTINCT doc_id, chunk_no, ord, CASE WHEN ord = 1 THEN 'pub' ELSE 'e' || CAST(ord - 1 AS VARCHAR) END AS s, tmp_id AS t FROM mentions)
    SELECT r.doc_id, r.ord, CASE WHEN s = 'pub' THEN 'pub_' || CAST(r.doc_id AS VARCHAR) ELSE a.real END AS source, b.real AS target, 'DESCRIBES_EXPERIMENT' AS type
    FROM r LEFT JOIN e a ON a.doc_id = r.doc_id AND a.chunk_no = r.chunk_no AND a.tmp_id = s JOIN e b ON b.doc_id = r.doc_id AND b.chunk_no = r.chunk_no AND b.tmp_id = t
    WHERE s = 'pub' OR a.real IS NOT NULL""",
)
def _(spark, d):
    m = by_name(spark, d)
    rels = m.select(
        "doc_id", "chunk_no", "ord", F.when(F.col("ord") == 1, "pub").otherwise(F.concat(F.lit("e"), (F.col("ord") - 1).cast("string"))).alias("source_tmp"),
        F.col("tmp_id").alias("target_tmp"), F.lit("DESCRIBES_EXPERIMENT").alias("type"),
    ).distinct()
    pubs = m.select("doc_id").distinct().withColumn("pub_id", F.concat(F.lit("pub_"), F.col("doc_id").cast("string")))
    return C.resolve_relation_endpoints(rels, m, pubs).drop("chunk_no")


@query(
    "validate_relations", "g_nodes g_edges",
    """WITH p AS (SELECT source, target, CASE WHEN length(target) % 11 = 0 THEN 'ON_EQUIPMENT' ELSE type END AS type FROM g_edges),
    t AS (SELECT p.*, s.type AS st, e.type AS tt FROM p JOIN g_nodes s ON s.id = source JOIN g_nodes e ON e.id = target)
    SELECT source, target, type, type <> 'ON_EQUIPMENT' OR (st = 'experiment' AND tt = 'equipment') AS accepted,
      CASE WHEN type <> 'ON_EQUIPMENT' THEN 0 ELSE CASE WHEN st = 'experiment' THEN 0 ELSE 1 END + CASE WHEN tt = 'equipment' THEN 0 ELSE 1 END END::BIGINT AS n_issues FROM t""",
)
def _(spark, d):
    p = edges(spark, d).withColumn("type", F.when(F.length("target") % 11 == 0, "ON_EQUIPMENT").otherwise(F.col("type")))
    return C.validate_relations(node_names(spark, d), p).select("source", "target", "type", "accepted", F.size("issues").cast("long").alias("n_issues"))


@query(
    "validate_verification_fields", "g_nodes",
    """WITH v AS (SELECT id, type, coalesce(date, '') AS date, CASE WHEN type = 'conclusion' THEN '' ELSE name END AS source_file, coalesce(country, '') AS confidence FROM g_nodes WHERE type IN ('experiment', 'conclusion', 'publication'))
    SELECT id, type, 'date' AS field FROM v WHERE date = '' UNION ALL SELECT id, type, 'source_file' FROM v WHERE source_file = '' UNION ALL SELECT id, type, 'confidence' FROM v WHERE confidence = ''""",
)
def _(spark, d):
    n = nodes(spark, d)
    return C.validate_verification_fields(
        n.select("id", "type", "date", F.when(F.col("type") == "conclusion", "").otherwise(F.col("name")).alias("source_file"), F.col("country").alias("confidence"))
    )


@query(
    "edge_upsert", "",
    """WITH r AS (SELECT 'exp_' || CAST(l_orderkey AS VARCHAR) AS source, 'mat_' || CAST(l_partkey AS VARCHAR) AS target, (l_linenumber, l_suppkey, l_extendedprice) AS seq,
        l_linestatus AS status, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag FROM lineitem)
    SELECT source, target, 'USES_MATERIAL' AS type, 'status' AS key, arg_max(status, seq) AS value FROM r GROUP BY 1, 2
    UNION ALL SELECT source, target, 'USES_MATERIAL', 'flag', arg_max(flag, seq) FROM r WHERE flag IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, d):
    attrs = F.map_filter(
        F.create_map(F.lit("status"), F.col("l_linestatus"), F.lit("flag"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag"))), lambda k, v: v.isNotNull()
    )
    e = table(spark, d, "lineitem").select(
        F.concat(F.lit("exp_"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("mat_"), F.col("l_partkey").cast("string")).alias("target"),
        F.lit("USES_MATERIAL").alias("type"), attrs.alias("attrs_str"), F.struct("l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"),
    )
    return C.edge_upsert(e)


FACTS = """fm AS (SELECT *, 'material_' || left(sha1(lower(trim(name))), 16) AS entity_id FROM mentions),
    fr AS (SELECT entity_id, 'discount_pct' AS attr, discount_pct AS num, NULL AS text, source_file, pos FROM fm WHERE discount_pct IS NOT NULL
      UNION ALL SELECT entity_id, 'spelling', NULL, name, source_file, pos FROM fm
      UNION ALL SELECT entity_id, 'rebate', CASE WHEN discount_pct < 5 THEN discount_pct END, CASE WHEN discount_pct >= 5 THEN 'high' END, source_file, pos FROM fm WHERE discount_pct IS NOT NULL)"""


def stated(spark, d):
    """Mentions with a number, a text and an attribute that is either; null values state nothing."""
    number, text = F.col("discount_pct"), F.lit(None).cast("string")
    low = number < 5
    return (
        by_name(spark, d)
        .withColumn("attrs_num", F.create_map(F.lit("discount_pct"), number, F.lit("rebate"), F.when(low, number)))
        .withColumn("attrs_str", F.create_map(F.lit("spelling"), F.col("name"), F.lit("rebate"), F.when(~low, "high").otherwise(text)))
    )


@query(
    "fact_versions", "mentions",
    f"""WITH {FACTS}, h AS (SELECT *, lag(num) OVER w AS old_num, lag(text) OVER w AS old_text, lag(pos) OVER w AS old_pos FROM fr
      WINDOW w AS (PARTITION BY entity_id, attr ORDER BY pos, num NULLS FIRST, text NULLS FIRST, source_file))
    SELECT entity_id, attr, old_num AS old_value, num AS new_value, old_text, text AS new_text, source_file, pos FROM h
    WHERE old_pos IS NOT NULL AND (old_num IS DISTINCT FROM num OR old_text IS DISTINCT FROM text)""",
)
def _(spark, d):
    return C.mention_history(stated(spark, d)).select(
        "entity_id", "attr", F.col("old_value.num").alias("old_value"), F.col("new_value.num").alias("new_value"),
        F.col("old_value.text").alias("old_text"), F.col("new_value.text").alias("new_text"), "source_file", "pos",
    )


@query(
    "current_facts", "mentions",
    f"""WITH {FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, attr ORDER BY pos DESC, num DESC NULLS LAST, text DESC NULLS LAST, source_file DESC) AS k FROM fr)
    SELECT entity_id, attr, num AS value, text, source_file FROM r WHERE k = 1""",
)
def _(spark, d):
    return C.current_facts(C.fact_rows(stated(spark, d))).select("entity_id", "attr", F.col("value.num").alias("value"), F.col("value.text").alias("text"), "source_file")


@query("source_accumulation", "mentions", f"WITH {FACTS} SELECT entity_id, source_file, min(pos) AS first_pos FROM fm GROUP BY 1, 2")
def _(spark, d):
    return C.source_accumulation(by_name(spark, d))


@query(
    "infer_confidence", "mentions",
    """WITH e AS (SELECT 'p' || CAST(l_partkey AS VARCHAR) || l_shipmode AS entity_id, l_tax > 0.02 AS num, 'src' || CAST(l_suppkey % 3 AS VARCHAR) AS src FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)),
    a AS (SELECT entity_id, count(DISTINCT src) AS n_sources, bool_or(num) AS has_numeric FROM e GROUP BY 1)
    SELECT *, CASE WHEN has_numeric AND n_sources >= 2 THEN 'высокая' WHEN NOT has_numeric AND n_sources <= 1 THEN 'низкая' ELSE 'средняя' END AS confidence FROM a""",
)
def _(spark, d):
    """Entities per part and flags; only a tax above 2 percent is stored under a key with a unit."""
    m = table(spark, d, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string"), "l_returnflag", "l_linestatus").alias("entity_id"),
        F.concat(F.lit("src"), (F.col("l_suppkey") % 3).cast("string")).alias("source_file"),
        F.create_map(F.when(F.col("l_tax") > 0.02, "tax_pct").otherwise("tax"), F.col("l_tax")).alias("attrs_num"),
    )
    return C.infer_confidence(m)


CANDIDATES = """pc AS (SELECT source AS exp, target AS concl FROM g_edges WHERE type = 'PRODUCES_CONCLUSION'),
    um AS (SELECT source AS exp, target AS mat FROM g_edges WHERE type = 'USES_MATERIAL'), up AS (SELECT source AS exp, target AS proc FROM g_edges WHERE type = 'USES_PROCESS'),
    k AS (SELECT pc.exp, concl, mat, proc FROM pc JOIN um USING (exp) JOIN up USING (exp)),
    cd AS (SELECT DISTINCT a.concl AS a_id, b.concl AS b_id FROM k a JOIN k b ON a.mat = b.mat AND a.proc = b.proc AND a.concl < b.concl AND a.exp <> b.exp),
    free AS (SELECT * FROM cd WHERE (a_id, b_id) NOT IN (SELECT source, target FROM g_edges WHERE type = 'CONTRADICTS') AND (b_id, a_id) NOT IN (SELECT source, target FROM g_edges WHERE type = 'CONTRADICTS'))"""


@query("review_candidates", "g_edges", f"WITH {CANDIDATES} SELECT a_id, b_id FROM free")
def _(spark, d):
    return C.review_candidates(node_names(spark, d), edges(spark, d))


@query("needs_review_pairs")
def _(spark, d):
    return C.needs_review_pairs(node_names(spark, d), edges(spark, d))


EXTERNAL_SQL = """x AS (SELECT item_id, kind, title, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'http://src.example/' || CAST(item_id % 10 AS VARCHAR) END AS url, year, p_name, p_type
      FROM external_sources LEFT JOIN part ON p_partkey = item_id),
    xi AS (SELECT *, 'rg_ext_' || kind || '_' || trim(left(regexp_replace(CASE WHEN url = '' THEN title ELSE url END, '[^a-zA-Z0-9_]', '_', 'g'), 48), '_') AS id FROM x),
    xf AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY item_id) AS k FROM xi),
    pubs AS (SELECT id, title AS name, CAST(year AS VARCHAR) AS date, kind AS origin, p_name, p_type FROM xf WHERE k = 1),
    tg AS (SELECT lower(name) AS lkw, max(id) AS target FROM g_nodes WHERE type <> 'publication' AND name <> '' GROUP BY 1),
    ln AS (SELECT pubs.id AS source, target, min(kw) AS keyword FROM (SELECT id, unnest([p_name, p_type]) AS kw FROM pubs) pubs JOIN tg ON lkw = lower(kw) GROUP BY 1, 2)"""


def external(spark, d):
    src = view(spark, d, "external_sources").join(table(spark, d, "part"), F.col("p_partkey") == F.col("item_id"), "left")
    return src.select(
        "kind", "title", "year", F.col("item_id").alias("rank"),
        F.when(F.col("item_id") % 3 == 0, "").otherwise(F.concat(F.lit("http://src.example/"), (F.col("item_id") % 10).cast("string"))).alias("url"),
        F.array_compact(F.array("p_name", "p_type")).alias("matched_keywords"),
    )


@query("external_mentions", "external_sources g_nodes", f"WITH {EXTERNAL_SQL} SELECT source, target, keyword, 'MENTIONS' AS type FROM ln")
def _(spark, d):
    return C.external_mentions(external(spark, d), nodes(spark, d))[1]


@query("external_publications", "external_sources g_nodes", f"WITH {EXTERNAL_SQL} SELECT id, trim(name) AS name, date, origin FROM pubs")
def _(spark, d):
    return C.external_mentions(external(spark, d), nodes(spark, d))[0].select("id", "name", "date", "origin")


@query(
    "session_graph_stats", "external_sources g_nodes g_edges",
    f"""WITH {EXTERNAL_SQL} SELECT (SELECT count(*) FROM g_nodes WHERE type <> 'publication') AS entities, (SELECT count(*) FROM g_nodes WHERE type = 'publication') + (SELECT count(*) FROM pubs) AS publications,
      (SELECT count(*) FROM pubs) AS external_pubs, (SELECT count(*) FROM g_edges) + (SELECT count(*) FROM ln) AS relations, (SELECT count(*) FROM documents) AS chunks""",
)
def _(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    pubs, links = C.external_mentions(external(spark, d), n)
    all_nodes = n.select("id", "type", F.lit(None).cast("string").alias("origin")).unionByName(pubs.select("id", "type", "origin"))
    return C.session_graph_stats(all_nodes, e.unionByName(links.select("source", "target", "type")), table(spark, d, "documents"))
