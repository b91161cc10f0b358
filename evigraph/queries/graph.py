"""Graph queries (G rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import graph as G
from evigraph.operators.matching import find_by_names
from evigraph.queries.registry import query
from evigraph.sources.star import edges, node_names, nodes, table, view

SLOTS = {"material": ["ring", "blue bolt"], "condition": "5-LOW"}
NUMERIC = [("discount_pct", "<=", 5.0), ("price_musd", ">=", 100000.0)]
TWO_WAY = "(contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})))"


@query("entities_by_type", "g_nodes", "SELECT id, type, name FROM g_nodes WHERE type = 'equipment'")
def _(spark, d):
    return G.entities_by_type(node_names(spark, d), "equipment").select("id", "type", "name")


@query(
    "find_by_name", "g_nodes",
    "SELECT id, type, name FROM g_nodes WHERE type IN ('material', 'process') AND name <> '' AND (contains(lower(name), 'red ring') OR contains('red ring', lower(name)))",
)
def _(spark, d):
    return G.find_by_name(node_names(spark, d), "Red Ring", ["material", "process"]).select("id", "type", "name")


@query(
    "find_by_name_batch", "g_nodes",
    f"""WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS query FROM part
         UNION SELECT DISTINCT 'the large ' || c_mktsegment || ' team' FROM customer)
    SELECT DISTINCT query, lower(name) AS lname, type FROM q JOIN g_nodes
      ON type IN ('material', 'process', 'team', 'equipment') AND name <> '' AND {TWO_WAY.format(a='name', b='query')}""",
)
def _(spark, d):
    asked = (
        table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("query"))
        .union(table(spark, d, "customer").select(F.concat(F.lit("the large "), "c_mktsegment", F.lit(" team"))))
    )
    return find_by_names(node_names(spark, d), asked, ["material", "process", "team", "equipment"])


@query(
    "node_lookup", "g_nodes",
    "SELECT id, type, name FROM g_nodes WHERE id IN (SELECT 'exp_' || CAST(doc_id AS STRING) FROM labels WHERE quality = 1)",
)
def _(spark, d):
    ids = table(spark, d, "labels").filter("quality = 1").select(F.concat(F.lit("exp_"), F.col("doc_id").cast("string")).alias("id"))
    return G.node_lookup(node_names(spark, d), ids).select("id", "type", "name")


@query(
    "khop_neighbors", "g_nodes g_edges",
    """WITH und AS (SELECT source AS a, target AS b FROM g_edges UNION SELECT target, source FROM g_edges),
    h0 AS (SELECT id AS seed_id, id AS node_id FROM g_nodes WHERE type = 'topic'),
    h1 AS (SELECT DISTINCT seed_id, b AS node_id FROM h0 JOIN und ON node_id = a),
    h2 AS (SELECT DISTINCT seed_id, b AS node_id FROM h1 JOIN und ON node_id = a)
    SELECT seed_id, node_id, CAST(min(hop) AS INTEGER) AS hop FROM (
      SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2""",
)
def _(spark, d):
    n = node_names(spark, d)
    seeds = G.entities_by_type(n, "topic").select(F.col("id").alias("seed_id"))
    return G.khop_neighbors(n, edges(spark, d), seeds, 2)


@query(
    "induced_subgraph", "g_nodes g_edges",
    """WITH keep AS (SELECT id FROM g_nodes WHERE country = 'EU'),
    deg AS (SELECT x AS id, count(*) AS degree FROM (SELECT source AS x FROM g_edges UNION ALL SELECT target FROM g_edges) GROUP BY x)
    SELECT n.id, n.type, n.name, coalesce(degree, 0) AS degree, NULL AS source, NULL AS target FROM g_nodes n JOIN keep USING (id) LEFT JOIN deg USING (id)
    UNION ALL SELECT NULL, type, NULL, NULL, source, target FROM g_edges WHERE source IN (SELECT id FROM keep) AND target IN (SELECT id FROM keep)""",
)
def _(spark, d):
    n = node_names(spark, d)
    return G.subgraph_rows(*G.induced_subgraph(n, edges(spark, d), G.country_filter(n, "EU"), ranged=True))


@query(
    "induced_subgraph_edges", "g_nodes g_edges",
    """WITH keep AS (SELECT id FROM g_nodes WHERE country = 'EU')
    SELECT source, target, type FROM g_edges WHERE source IN (SELECT id FROM keep) AND target IN (SELECT id FROM keep)""",
)
def _(spark, d):
    n = node_names(spark, d)
    return G.edges_within(edges(spark, d), G.country_filter(n, "EU"))


@query(
    "node_degree", "g_nodes g_edges",
    """WITH deg AS (SELECT x AS id, count(*) AS degree FROM (SELECT source AS x FROM g_edges UNION ALL SELECT target FROM g_edges) GROUP BY x)
    SELECT id, coalesce(degree, 0) AS degree FROM g_nodes LEFT JOIN deg USING (id)""",
)
def _(spark, d):
    return G.node_degree(node_names(spark, d), edges(spark, d))


EXPERIMENT_SEARCH_SQL = f"""SELECT id, name, date, country, price_musd, discount_pct FROM g_nodes e WHERE type = 'experiment'
      AND EXISTS (SELECT 1 FROM g_edges x JOIN g_nodes t ON x.target = t.id WHERE x.source = e.id AND x.type = 'USES_MATERIAL'
                  AND ({TWO_WAY.format(a='t.name', b="'ring'")} OR {TWO_WAY.format(a='t.name', b="'blue bolt'")}))
      AND EXISTS (SELECT 1 FROM g_edges x JOIN g_nodes t ON x.target = t.id WHERE x.source = e.id AND x.type = 'AT_CONDITION'
                  AND {TWO_WAY.format(a='t.name', b="'5-low'")})
      AND upper(country) = 'EU' AND discount_pct <= 5 AND price_musd >= 100000"""


@query("experiment_search", "g_nodes g_edges", EXPERIMENT_SEARCH_SQL)
def _(spark, d):
    found = G.experiment_search(nodes(spark, d), edges(spark, d), SLOTS, "eu", NUMERIC)
    return found.select("id", "name", "date", "country", "price_musd", "discount_pct")


@query(
    "numeric_range_filter", "g_nodes",
    """WITH preds AS (
      SELECT CAST(n_nationkey AS BIGINT) AS set_id, 'price_musd' AS key, '>=' AS op, n_nationkey * 16000.0 AS value FROM nation
      UNION ALL SELECT n_nationkey, 'discount_pct', CASE WHEN n_nationkey % 5 = 4 THEN '!=' WHEN n_nationkey % 2 = 0 THEN '<=' ELSE '<' END, n_nationkey % 10 FROM nation),
    vals AS (SELECT id, 'price_musd' AS key, price_musd AS v FROM g_nodes UNION ALL SELECT id, 'discount_pct', discount_pct FROM g_nodes)
    SELECT set_id, id FROM preds JOIN vals USING (key)
    GROUP BY set_id, id HAVING count(*) = 2 AND bool_and(coalesce(CASE op WHEN '>=' THEN v >= value WHEN '<=' THEN v <= value WHEN '<' THEN v < value ELSE false END, false))""",
)
def _(spark, d):
    key = F.col("n_nationkey")
    nat = table(spark, d, "nation")
    op = F.when(key % 5 == 4, "!=").when(key % 2 == 0, "<=").otherwise("<")
    preds = nat.select(
        key.cast("long").alias("set_id"),
        F.explode(
            F.array(
                F.struct(F.lit("price_musd").alias("key"), F.lit(">=").alias("op"), (key * 16000).cast("double").alias("value")),
                F.struct(F.lit("discount_pct").alias("key"), op.alias("op"), (key % 10).cast("double").alias("value")),
            )
        ).alias("p"),
    ).select("set_id", "p.*")
    return G.numeric_range_filter(nodes(spark, d), preds)


@query("country_filter", "g_nodes", "SELECT id, country FROM g_nodes WHERE upper(country) = 'EU'")
def _(spark, d):
    return G.country_filter(node_names(spark, d), "eu").select("id", "country")


@query("date_cutoff_filter", "g_nodes", "SELECT id, date FROM g_nodes WHERE coalesce(date, '') >= '1999-07-01'")
def _(spark, d):
    return G.date_cutoff_filter(node_names(spark, d), "1999-07-01").select("id", "date")


@query(
    "experiment_detail", "g_nodes g_edges",
    """WITH e AS (SELECT id FROM g_nodes WHERE type = 'experiment'),
    l AS (SELECT source AS experiment_id, type AS relation, target AS node_id FROM g_edges WHERE source IN (SELECT id FROM e)
          UNION ALL SELECT target, 'incoming::' || type, source FROM g_edges WHERE target IN (SELECT id FROM e))
    SELECT experiment_id, relation, node_id, n.type AS node_type, n.name AS node_name FROM l JOIN g_nodes n ON n.id = node_id""",
)
def _(spark, d):
    n = node_names(spark, d)
    return G.experiment_detail(n, edges(spark, d), G.entities_by_type(n, "experiment"), ranged=True)


GAP_COUNTS = """counts AS (SELECT a.target AS x_id, b.target AS y_id, count(DISTINCT a.source) AS c FROM g_edges a JOIN g_edges b
      ON a.source = b.source WHERE a.type = 'USES_MATERIAL' AND b.type = '{rel}' GROUP BY 1, 2)"""


@query(
    "gap_matrix", "g_nodes g_edges",
    f"""WITH {GAP_COUNTS.format(rel='AT_FACILITY')}
    SELECT x.id AS x_id, x.name AS x_name, y.id AS y_id, y.name AS y_name, coalesce(c, 0) AS count
    FROM g_nodes x JOIN g_nodes y ON x.type = 'material' AND y.type = 'facility' LEFT JOIN counts ON x_id = x.id AND y_id = y.id""",
)
def _(spark, d):
    return G.gap_matrix(node_names(spark, d), edges(spark, d), "material", "facility")


@query(
    "gaps_only", "g_nodes g_edges",
    f"""WITH {GAP_COUNTS.format(rel='AT_CONDITION')}
    SELECT x.id AS x_id, x.name AS x_name, y.id AS y_id, y.name AS y_name
    FROM g_nodes x JOIN g_nodes y ON x.type = 'material' AND y.type = 'condition' LEFT JOIN counts ON x_id = x.id AND y_id = y.id WHERE c IS NULL""",
)
def _(spark, d):
    return G.gaps_only(node_names(spark, d), edges(spark, d), "material", "condition")


@query(
    "ghost_links", "g_nodes g_edges",
    f"""WITH {GAP_COUNTS.format(rel='AT_FACILITY')},
    gaps AS (SELECT x.id AS x_id, x.name AS x_name, y.id AS y_id, y.name AS y_name
      FROM g_nodes x JOIN g_nodes y ON x.type = 'material' AND y.type = 'facility' LEFT JOIN counts ON x_id = x.id AND y_id = y.id WHERE c IS NULL)
    SELECT x_id AS source, 'ghost::' || x_id || '::' || y_id AS target, 'GAP' AS type, x_name || ' × ' || y_name AS ghost_name FROM gaps
    UNION ALL SELECT y_id, 'ghost::' || x_id || '::' || y_id, 'GAP', x_name || ' × ' || y_name FROM gaps""",
)
def _(spark, d):
    return G.ghost_links(G.gaps_only(node_names(spark, d), edges(spark, d), "material", "facility"))


@query(
    "contradictions", "g_nodes g_edges",
    """WITH ids AS (SELECT target AS id FROM g_edges JOIN g_nodes e ON e.id = source WHERE g_edges.type = 'PRODUCES_CONCLUSION' AND e.country = 'EU')
    SELECT a.id AS a_id, a.name AS a_name, b.id AS b_id, b.name AS b_name, '' AS note FROM g_edges x JOIN g_nodes a ON a.id = x.source JOIN g_nodes b ON b.id = x.target
    WHERE x.type = 'CONTRADICTS' AND (x.source IN (SELECT id FROM ids) OR x.target IN (SELECT id FROM ids))""",
)
def _(spark, d):
    n, e = node_names(spark, d), edges(spark, d)
    eu = G.country_filter(G.entities_by_type(n, "experiment"), "EU").select(F.col("id").alias("source"))
    ids = e.filter("type = 'PRODUCES_CONCLUSION'").join(eu, "source", "left_semi").select(F.col("target").alias("id"))
    return G.contradictions(n, e, ids)


@query("timeline", "g_nodes", "SELECT id, type, name, date FROM g_nodes WHERE coalesce(date, '') <> '' ORDER BY date, id")
def _(spark, d):
    return G.timeline(node_names(spark, d))


CUT = "1998-01-01"


@query("timeline_cutoff_subgraph", "g_nodes g_edges",
       f"""WITH k AS (SELECT id FROM g_nodes WHERE coalesce(date, '') = '' OR date <= '{CUT}')
       SELECT source, target, type FROM g_edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)""")
def _(spark, d):
    return G.edges_within(edges(spark, d), G.timeline_cutoff_nodes(node_names(spark, d), CUT))


@query("type_filter_subgraph", "g_nodes g_edges",
       """WITH k AS (SELECT id FROM g_nodes WHERE type IN ('publication', 'topic', 'expert', 'team'))
       SELECT source, target, type FROM g_edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)""")
def _(spark, d):
    return G.edges_within(edges(spark, d), G.type_filter_nodes(node_names(spark, d), ["publication", "topic", "expert", "team"]))


@query("graph_counts", "g_nodes g_edges", "SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges")
def _(spark, d):
    return G.graph_counts(node_names(spark, d), edges(spark, d))


ENUM = "(VALUES ('publication'), ('experiment'), ('material'), ('process'), ('property'), ('condition'), ('equipment'), ('facility'), ('team'), ('expert'), ('topic'), ('conclusion')) t(type)"


@query("coverage_by_type", "g_nodes",
       f"WITH known AS (SELECT type, count(*) AS n FROM g_nodes WHERE coalesce(country, '') = '' GROUP BY type) SELECT type, coalesce(n, 0) AS n FROM {ENUM} LEFT JOIN known USING (type)")
def _(spark, d):
    return G.coverage_by_type(node_names(spark, d).filter(F.coalesce("country", F.lit("")) == ""))


CHAIN_SQL = """WITH pub AS (SELECT target AS experiment_id, min(source) AS publication_id FROM g_edges JOIN g_nodes p ON p.id = source
       WHERE g_edges.type = 'DESCRIBES_EXPERIMENT' AND p.type = 'publication' GROUP BY target)
    SELECT x.source AS experiment_id, e.name AS experiment_name, publication_id, p.name AS publication_name,
      CAST(CASE x.type WHEN 'USES_MATERIAL' THEN 0 WHEN 'USES_PROCESS' THEN 1 WHEN 'ON_EQUIPMENT' THEN 2 ELSE 3 END AS BIGINT) AS step_no,
      CASE x.type WHEN 'USES_MATERIAL' THEN 'material' WHEN 'USES_PROCESS' THEN 'process' WHEN 'ON_EQUIPMENT' THEN 'equipment' ELSE 'result' END AS step,
      x.target AS item_id, t.name AS item_name, CASE x.type WHEN 'MEASURES_PROPERTY' THEN 'property' WHEN 'PRODUCES_CONCLUSION' THEN 'conclusion' END AS kind
    FROM g_edges x JOIN g_nodes e ON e.id = x.source AND e.type = 'experiment' JOIN g_nodes t ON t.id = x.target
      LEFT JOIN pub ON pub.experiment_id = x.source LEFT JOIN g_nodes p ON p.id = publication_id
    WHERE x.type IN ('USES_MATERIAL', 'USES_PROCESS', 'ON_EQUIPMENT', 'MEASURES_PROPERTY', 'PRODUCES_CONCLUSION')"""


@query("experiment_chains", "g_nodes g_edges", CHAIN_SQL)
def _(spark, d):
    return G.experiment_chains(node_names(spark, d), edges(spark, d))


@query(
    "chain_step_edges", "g_nodes g_edges",
    """WITH f AS (SELECT source AS exp, min(CASE WHEN type = 'USES_MATERIAL' THEN target END) AS m, min(CASE WHEN type = 'USES_PROCESS' THEN target END) AS p,
        min(CASE WHEN type = 'ON_EQUIPMENT' THEN target END) AS q,
        coalesce(min(CASE WHEN type = 'MEASURES_PROPERTY' THEN target END), min(CASE WHEN type = 'PRODUCES_CONCLUSION' THEN target END)) AS r
      FROM g_edges WHERE source LIKE 'exp%' GROUP BY source),
    s AS (SELECT exp, 0 AS k, m AS id FROM f UNION ALL SELECT exp, 1, p FROM f UNION ALL SELECT exp, 2, q FROM f UNION ALL SELECT exp, 3, r FROM f),
    n AS (SELECT id AS source, lead(id) OVER (PARTITION BY exp ORDER BY k) AS target FROM s WHERE id IS NOT NULL)
    SELECT DISTINCT source, target, 'CHAIN_STEP' AS type FROM n WHERE target IS NOT NULL""",
)
def _(spark, d):
    return G.chain_step_edges(node_names(spark, d), edges(spark, d))


@query(
    "path_nodes", "g_nodes g_edges",
    """WITH e AS (SELECT id FROM g_nodes WHERE type = 'experiment' AND country = 'EU' AND date >= '1999-01-01'),
    near AS (SELECT target AS id, type FROM g_edges WHERE source IN (SELECT id FROM e) AND type IN ('USES_MATERIAL', 'USES_PROCESS', 'AT_CONDITION', 'MEASURES_PROPERTY', 'PRODUCES_CONCLUSION')),
    c AS (SELECT source, target FROM g_edges WHERE type = 'CONTRADICTS' AND (source IN (SELECT id FROM near WHERE type = 'PRODUCES_CONCLUSION') OR target IN (SELECT id FROM near WHERE type = 'PRODUCES_CONCLUSION')))
    SELECT id FROM e UNION SELECT id FROM near UNION SELECT source FROM c UNION SELECT target FROM c UNION SELECT id FROM g_nodes WHERE type = 'facility' AND country = 'EU'""",
)
def _(spark, d):
    n = node_names(spark, d)
    eu = G.country_filter(n, "EU")
    exps = G.date_cutoff_filter(G.entities_by_type(eu, "experiment"), "1999-01-01")
    return G.path_nodes(n, edges(spark, d), exps, G.entities_by_type(eu, "facility"))
