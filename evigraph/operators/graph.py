"""Graph queries over ``nodes`` and ``edges`` DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.skew import hot_key_hashes, spread_join
from evigraph.model import ANCHOR_RELATION, CHAIN_STEPS, entity_type_table, relation_type_table
from evigraph.session import cut_lineage, cut_to_table

SLOTS = {"material": "material", "process": "process", "condition": "condition",
         "equipment": "equipment", "facility": "facility", "prop": "property"}
MAX_DEPTH = 3


def entities_by_type(nodes: DataFrame, etype: str) -> DataFrame:
    return nodes.filter(F.col("type") == etype)


def two_way_contains(name: Column, query: Column) -> Column:
    """Case-folded: one holds the other; an empty side never matches."""
    n, q = F.lower(name), F.lower(query)
    return (n != "") & (q != "") & (F.contains(n, q) | F.contains(q, n))


def find_by_name(nodes: DataFrame, text: str, etypes: list[str] | None = None) -> DataFrame:
    hits = nodes.filter(two_way_contains(F.col("name"), F.lit(text.strip())))
    return hits.filter(F.col("type").isin(*etypes)) if etypes else hits


def node_lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def id_range(rows: DataFrame, column: str):
    """Test that an id can be one of ``rows``: it lies between the first and the last of them.

    Two ids whatever the table's size. No member fails the test, others may pass it: an exact join follows. Edges of
    other kinds of nodes so leave where they are scanned, before any shuffle.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    return lambda ids: ids.between(F.lit(low).cast("string"), F.lit(high).cast("string"))


def both_directions(edges: DataFrame) -> DataFrame:
    """The undirected view: one row per edge end."""
    return edges.select(
        F.explode(
            F.array(
                F.struct(F.col("source").alias("node_id"), F.col("target").alias("neighbor_id")),
                F.struct(F.col("target").alias("node_id"), F.col("source").alias("neighbor_id")),
            )
        ).alias("e")
    ).select("e.*")


def khop_neighbors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed_id, node_id, hop): every node within ``depth`` undirected steps, hop = shortest distance.

    All seeds walk together. The edges are stored once as a narrow table, because deriving them may take shuffles
    that every hop would repeat. Hub nodes are salted in the frontier join, each frontier is
    de-duplicated before it is joined again, and every hop is stored.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1..{MAX_DEPTH}")
    ends = both_directions(cut_to_table(edges.select("source", "target")))
    hubs = hot_key_hashes(ends, ["node_id"]).first()["hot"]  # one pass for all hops
    frontier = (
        seeds.select("seed_id").distinct()
        .join(nodes.select(F.col("id").alias("seed_id")), "seed_id", "left_semi")
        .select("seed_id", F.col("seed_id").alias("node_id"), F.lit(0).alias("hop"))
    )
    # Tables have their real size, so a small frontier is joined where the edges lie.
    frontier = cut_to_table(frontier)
    reached = frontier
    for hop in range(1, depth + 1):
        step = (
            spread_join(ends, frontier.select("seed_id", "node_id"), ["node_id"], hot=hubs)
            .select("seed_id", F.col("neighbor_id").alias("node_id"))
            .distinct()
        )
        frontier = step.join(reached.select("seed_id", "node_id"), ["seed_id", "node_id"], "left_anti").withColumn("hop", F.lit(hop))
        if hop < depth:
            frontier = cut_to_table(frontier)
        reached = reached.unionByName(frontier)
    return reached


def edges_within(edges: DataFrame, ids: DataFrame, ranged: bool = False) -> DataFrame:
    """Edges with both ends in ``ids(id)``.

    ``ranged`` reads the first and last id beforehand (the plan of ``ids`` runs once more), so that edges elsewhere are
    not shuffled.
    """
    keep = ids.select("id")
    if ranged:
        in_range = id_range(keep, "id")
        edges = edges.filter(in_range(F.col("source")) & in_range(F.col("target")))
    return edges.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(
        keep.withColumnRenamed("id", "target"), "target", "left_semi"
    )


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected multigraph degree, a self-loop counts 2, isolated nodes 0."""
    counts = both_directions(edges).groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def induced_subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame, ranged: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of the set with their whole-graph degree, and the edges among them (``ranged`` as in ``edges_within``)."""
    # A semi join needs no distinct ids. Hashed ids and counts instead of sorted ones: a task holds fewer buffers at once.
    keep = ids.select("id")
    inside = nodes.join(keep.hint("shuffle_hash"), "id", "left_semi")
    # Counted where the edges lie before the set is asked for: a hub of the set is one row per task, not one per edge.
    counts = both_directions(edges).groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    with_degree = inside.join(counts.hint("shuffle_hash"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return with_degree, edges_within(edges, keep, ranged)


def subgraph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type, name, degree, source, target): a row per node and a row per edge; an edge has no id, a node no ends."""
    return nodes.select("id", "type", "name", "degree").unionByName(edges.select("type", "source", "target"), allowMissingColumns=True)


def compare(actual: Column, op: Column, value: Column) -> Column:
    """False for a missing attribute and for an unknown operator."""
    return F.coalesce(
        F.when(op == "<=", actual <= value).when(op == "<", actual < value).when(op == ">=", actual >= value)
        .when(op == ">", actual > value).when(op == "=", actual == value),
        F.lit(False),
    )


RANGE_BINS = 64  # equi-depth bins of the values of a key
RANGE_FANOUT = 8


def numeric_range_filter(nodes: DataFrame, predicates: DataFrame, bins: int = RANGE_BINS) -> DataFrame:
    """(set_id, id): nodes that satisfy every (key, op, value) of a predicate set.

    A range join: the values of a key lie in equi-depth bins, a predicate covers a run of bins, and both meet in an
    equi join on key and bin. Only the predicate of a set that leaves the fewest nodes by the bins' counts takes
    part; the others of its set (a handful) are tested on the node's own attributes in the same row. So what is
    produced is bounded by each set's most selective predicate, and nothing is counted or grouped afterwards. A set
    with an unknown operator or a key that no node has matches nothing.
    """
    values = nodes.select("id", "attrs_num", F.explode("attrs_num").alias("key", "actual")).filter("actual IS NOT NULL")
    steps = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    depth = values.groupBy("key").agg(F.array_sort(F.array_distinct(F.percentile_approx("actual", steps, 10_000))).alias("edges"))
    depth = cut_lineage(depth)  # one row a key

    def bin_of(value: Column) -> Column:
        """Number of edges up to the value, which no larger value falls below."""
        return F.size(F.filter("edges", lambda e: e <= value))

    placed = cut_lineage(spread_join(values, depth, ["key"], fanout=RANGE_FANOUT).select("id", "attrs_num", "key", bin_of(F.col("actual")).alias("bin")))
    sizes = cut_lineage(placed.groupBy("key", "bin").agg(F.count("*").alias("n")))  # bins rows a key
    at = F.col("at")
    low = F.when(F.col("op").isin(">=", ">", "="), at).otherwise(0)
    high = F.when(F.col("op").isin("<=", "<", "="), at).otherwise(bins)
    known = F.col("op").isin("<=", "<", ">=", ">", "=")
    runs = predicates.join(depth, "key", "left").withColumn("at", bin_of(F.col("value"))).select("set_id", "key", "op", "value", F.when(known & F.col("edges").isNotNull(), low).otherwise(1).alias("low"), F.when(known & F.col("edges").isNotNull(), high).otherwise(0).alias("high"))
    covered = runs.join(sizes, (runs["key"] == sizes["key"]) & F.col("bin").between(F.col("low"), F.col("high")), "left")
    test = F.struct(*[runs[c] for c in ("key", "op", "value", "low", "high")])
    weighed = covered.groupBy(runs["set_id"], test.alias("test")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    sets = weighed.groupBy("set_id").agg(F.min_by("test", F.struct("n", "test")).alias("best"), F.collect_set("test").alias("tests"))
    asked = sets.filter("best.low <= best.high").select("set_id", "tests", F.col("best.key").alias("key"), F.explode(F.sequence("best.low", "best.high")).alias("bin"))
    met = spread_join(placed, asked, ["key", "bin"], fanout=RANGE_FANOUT)
    return met.filter(F.forall("tests", lambda t: compare(F.col("attrs_num")[t["key"]], t["op"], t["value"]))).select("set_id", "id")


def numeric_condition(filters: list[tuple[str, str, float]]) -> Column:
    """AND of fixed predicates; promoted columns are not assumed, the attribute map is read."""
    cond = F.lit(True)
    for key, op, value in filters:
        cond = cond & compare(F.col("attrs_num")[key], F.lit(op), F.lit(float(value)))
    return cond


def country_filter(nodes: DataFrame, country: str) -> DataFrame:
    return nodes.filter(F.upper("country") == country.upper())


def date_cutoff_filter(nodes: DataFrame, cutoff: str) -> DataFrame:
    """ISO text compares like the date it states; a node without a date fails."""
    return nodes.filter(F.coalesce("date", F.lit("")) >= cutoff)


def experiment_search(
    nodes: DataFrame,
    edges: DataFrame,
    slots: dict[str, str | list[str]] | None = None,
    country: str | None = None,
    numeric_filters: list[tuple[str, str, float]] | None = None,
) -> DataFrame:
    """Experiments whose links satisfy every given slot (OR inside a slot), plus attribute filters.

    One pass over the edges of the used relations, one aggregation by experiment with map-side
    combine, one semi join; the attribute filters run in the node scan.
    """
    exps = entities_by_type(nodes, "experiment")
    if country:
        exps = country_filter(exps, country)
    if numeric_filters:
        exps = exps.filter(numeric_condition(numeric_filters))
    asked = {k: [v] if isinstance(v, str) else list(v) for k, v in (slots or {}).items() if v}
    if not asked:
        return exps
    unknown = set(asked) - set(SLOTS)
    if unknown:
        raise ValueError(f"unknown slots: {sorted(unknown)}")
    flags = {}
    for slot, names in asked.items():
        hit = F.lit(False)
        for name in names:
            hit = hit | two_way_contains(F.col("name"), F.lit(name))
        flags[ANCHOR_RELATION[SLOTS[slot]]] = hit
    any_flag = F.lit(False)
    relation_ok = F.lit(False)
    for rel, hit in flags.items():
        any_flag = any_flag | hit
        relation_ok = relation_ok | ((F.col("e.type") == rel) & F.col(f"`{rel}`"))
    anchors = nodes.filter(any_flag).select("id", *[hit.alias(rel) for rel, hit in flags.items()])
    links = edges.filter(F.col("type").isin(*flags)).alias("e").join(anchors.alias("a"), F.col("e.target") == F.col("a.id"))
    # A flag per relation combines map-side in one shuffle; counting distinct relations would take two.
    has = {rel: F.max(F.col("e.type") == rel).alias(f"has_{rel}") for rel in flags}
    matched = links.filter(relation_ok).groupBy(F.col("e.source").alias("id")).agg(*has.values())
    for rel in has:
        matched = matched.filter(F.col(f"has_{rel}"))
    return exps.join(matched, "id", "left_semi")


def experiment_detail(nodes: DataFrame, edges: DataFrame, experiments: DataFrame, ranged: bool = False) -> DataFrame:
    """Long form: one row per neighbour, ``incoming::REL`` for in-edges.

    ``ranged`` reads the first and last experiment beforehand, so that edges elsewhere are not shuffled; it runs the
    plan of ``experiments`` once more, which pays where that is cheap.
    """
    exp = experiments.select(F.col("id").alias("experiment_id"))
    in_range = id_range(exp, "experiment_id") if ranged else lambda ids: F.lit(True)
    exp = exp.hint("shuffle_hash")
    out = edges.filter(in_range(F.col("source"))).join(exp, F.col("source") == F.col("experiment_id"), "left_semi").select(
        F.col("source").alias("experiment_id"), F.col("type").alias("relation"), F.col("target").alias("node_id")
    )
    incoming = edges.filter(in_range(F.col("target"))).join(exp, F.col("target") == F.col("experiment_id"), "left_semi").select(
        F.col("target").alias("experiment_id"), F.concat(F.lit("incoming::"), "type").alias("relation"), F.col("source").alias("node_id")
    )
    ends = nodes.select(F.col("id").alias("node_id"), F.col("type").alias("node_type"), F.col("name").alias("node_name")).hint("shuffle_hash")
    return out.unionByName(incoming).join(ends, "node_id").select("experiment_id", "relation", "node_id", "node_type", "node_name")


def _axis_relation(etype: str) -> str:
    if etype not in ANCHOR_RELATION:
        raise ValueError(f"no experiment relation for axis type {etype!r}; use one of {sorted(ANCHOR_RELATION)}")
    return ANCHOR_RELATION[etype]


def gap_counts(nodes: DataFrame, edges: DataFrame, x_type: str, y_type: str) -> DataFrame:
    """(x_id, y_id, count) of covered combinations, counted over experiments."""
    exps = entities_by_type(nodes, "experiment").select(F.col("id").alias("source"))
    ex = edges.filter(F.col("type") == _axis_relation(x_type)).select("source", F.col("target").alias("x_id")).join(exps, "source", "left_semi")
    ey = edges.filter(F.col("type") == _axis_relation(y_type)).select("source", F.col("target").alias("y_id"))
    return spread_join(ex, ey, ["source"]).groupBy("x_id", "y_id").agg(F.count(F.lit(1)).alias("count"))


AXIS_BLOCK = 256  # entities of the second axis in one row


def _gap_rows(nodes: DataFrame, edges: DataFrame, x_type: str, y_type: str) -> DataFrame:
    """(x_id, x_name, ys, counts): one row per entity of the first axis and block of the second one.

    ``ys`` lists the block's entities, ``counts`` maps the covered ones to their count (null: none). Cells are made
    from these rows where they lie, so only covered combinations are shuffled, never the grid.
    """
    xs = entities_by_type(nodes, x_type).select(F.col("id").alias("x_id"), F.col("name").alias("x_name"))
    ys = entities_by_type(nodes, y_type).select(F.col("id").alias("y_id"), F.col("name").alias("y_name"))
    blocks = max(1, -(-ys.count() // AXIS_BLOCK))
    block = F.pmod(F.xxhash64("y_id"), F.lit(blocks)).alias("block")
    axis = ys.select("*", block).groupBy("block").agg(F.collect_list(F.struct("y_id", "y_name")).alias("ys"))
    covered = (
        gap_counts(nodes, edges, x_type, y_type).filter("y_id IS NOT NULL").select("*", block)
        .groupBy("x_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("y_id", "count"))).alias("counts"))
    )
    rows = xs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    return rows.join(covered, ["x_id", "block"], "left").join(axis, "block").select("x_id", "x_name", "ys", "counts")


def gap_matrix(nodes: DataFrame, edges: DataFrame, x_type: str = "material", y_type: str = "condition") -> DataFrame:
    """(x_id, x_name, y_id, y_name, count) for every cell of the two axes: the grid itself is the report."""
    def cell(y: Column) -> Column:
        n = F.coalesce(F.try_element_at("counts", y["y_id"]), F.lit(0)).cast("long")
        return F.struct(y["y_id"].alias("y_id"), y["y_name"].alias("y_name"), n.alias("count"))

    return _gap_rows(nodes, edges, x_type, y_type).select("x_id", "x_name", F.inline(F.transform("ys", cell)))


def gaps_only(nodes: DataFrame, edges: DataFrame, x_type: str = "material", y_type: str = "condition") -> DataFrame:
    """(x_id, x_name, y_id, y_name) of the cells that no experiment covers."""
    free = F.filter("ys", lambda y: F.try_element_at("counts", y["y_id"]).isNull())
    return _gap_rows(nodes, edges, x_type, y_type).select("x_id", "x_name", F.inline(free))


def ghost_links(gaps: DataFrame) -> DataFrame:
    """Two GAP edges per gap, from each axis node to the ghost node of the cell."""
    ghost = F.concat(F.lit("ghost::"), "x_id", F.lit("::"), "y_id")
    return gaps.select(
        F.explode(F.array("x_id", "y_id")).alias("source"),
        ghost.alias("target"),
        F.lit("GAP").alias("type"),
        F.concat("x_name", F.lit(" × "), "y_name").alias("ghost_name"),
    )


def contradictions(nodes: DataFrame, edges: DataFrame, conclusion_ids: DataFrame) -> DataFrame:
    """CONTRADICTS edges with either end in ``conclusion_ids(id)``, with both names."""
    note = F.coalesce(F.col("attrs_str")["note"], F.lit("")) if "attrs_str" in edges.columns else F.lit("")
    pairs = edges.filter(F.col("type") == "CONTRADICTS").select(F.col("source").alias("a_id"), F.col("target").alias("b_id"), note.alias("note"))
    ids = conclusion_ids.select("id").distinct()
    hit = (
        pairs.join(ids.withColumnRenamed("id", "a_id"), "a_id", "left_semi")
        .unionByName(pairs.join(ids.withColumnRenamed("id", "b_id"), "b_id", "left_semi"))
        .distinct()
    )
    names = nodes.select("id", "name")
    return (
        hit.join(names.select(F.col("id").alias("a_id"), F.col("name").alias("a_name")), "a_id")
        .join(names.select(F.col("id").alias("b_id"), F.col("name").alias("b_name")), "b_id")
        .select("a_id", "a_name", "b_id", "b_name", "note")
    )


def timeline(nodes: DataFrame) -> DataFrame:
    dated = nodes.filter(F.coalesce("date", F.lit("")) != "")
    return dated.select("id", "type", "name", "date").orderBy("date", "id")


def timeline_cutoff_nodes(nodes: DataFrame, cutoff: str) -> DataFrame:
    """Undated nodes always show, dated ones up to the cutoff."""
    date = F.coalesce("date", F.lit(""))
    return nodes.filter((date == "") | (date <= cutoff))


def type_filter_nodes(nodes: DataFrame, etypes: list[str]) -> DataFrame:
    return nodes.filter(F.col("type").isin(*etypes))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row; each side is counted inside its own tasks."""
    tagged = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0), F.lit(1)))
    return tagged.agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"))


def coverage_by_type(nodes: DataFrame) -> DataFrame:
    counts = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return (
        F.broadcast(entity_type_table(nodes.sparkSession)).join(counts, "type", "left")
        .select("type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    )


def experiment_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Long form of the material, process, equipment, result chains.

    One row per chain item. The publication is the smallest id that describes the experiment.
    An experiment without items yields no row.
    """
    step_of = {rel: (step, no, kind) for no, (step, rels) in enumerate(CHAIN_STEPS.items()) for kind, rel in enumerate(rels)}
    exps = entities_by_type(nodes, "experiment").select(F.col("id").alias("experiment_id"), F.col("name").alias("experiment_name"))
    pubs = entities_by_type(nodes, "publication").select(F.col("id").alias("pub_id"), F.col("name").alias("pub_name"))
    first_pub = (
        edges.filter(F.col("type") == "DESCRIBES_EXPERIMENT")
        .join(pubs, F.col("source") == F.col("pub_id"))
        .groupBy(F.col("target").alias("experiment_id"))
        .agg(F.min(F.struct("pub_id", "pub_name")).alias("p"))
        .select("experiment_id", F.col("p.pub_id").alias("publication_id"), F.col("p.pub_name").alias("publication_name"))
    )
    # What follows from the relation is written out after the joins, so that only its number travels.
    rels = list(step_of)
    items = edges.filter(F.col("type").isin(*rels)).select(
        F.col("source").alias("experiment_id"), F.col("target").alias("item_id"),
        F.coalesce(*[F.when(F.col("type") == rel, F.lit(i)) for i, rel in enumerate(rels)]).cast("byte").alias("rel"),
    )
    per_rel = lambda values, kind: F.coalesce(*[F.when(F.col("rel") == i, F.lit(v).cast(kind)) for i, v in enumerate(values)])
    names = nodes.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"))
    return (
        items.join(names, "item_id")
        .join(exps, "experiment_id")
        .join(first_pub, "experiment_id", "left")
        .select(
            "experiment_id", "experiment_name", "publication_id", "publication_name",
            per_rel([no for _, no, _ in step_of.values()], "long").alias("step_no"), per_rel([step for step, _, _ in step_of.values()], "string").alias("step"),
            "item_id", "item_name",
            F.when(F.col("rel") == rels.index("MEASURES_PROPERTY"), "property").when(F.col("rel") == rels.index("PRODUCES_CONCLUSION"), "conclusion").alias("kind"),
        )
    )


def chain_step_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """CHAIN_STEP between the first items of consecutive non-empty steps, without duplicates.

    First = smallest id; in the result step a property comes before a conclusion.
    """
    def first(rel: str) -> Column:
        return F.min(F.when(F.col("type") == rel, F.col("target")))

    rels = [rel for group in CHAIN_STEPS.values() for rel in group]
    exps = entities_by_type(nodes, "experiment").select(F.col("id").alias("source"))
    firsts = (
        edges.filter(F.col("type").isin(*rels)).join(exps, "source", "left_semi")
        .groupBy("source").agg(*[first(rel).alias(rel) for rel in rels])
    )
    path = F.filter(
        F.array(*[F.coalesce(*[F.col(rel) for rel in group]) for group in CHAIN_STEPS.values()]), lambda x: x.isNotNull()
    )
    pairs = F.zip_with(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), F.slice("path", 2, F.size("path")),
                       lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    return (
        firsts.select(path.alias("path")).filter(F.size("path") > 1)
        .select(F.explode(pairs).alias("p"))
        .select("p.source", "p.target", F.lit("CHAIN_STEP").alias("type"))
        .distinct()
    )


PATH_RELATIONS = ("USES_MATERIAL", "USES_PROCESS", "AT_CONDITION", "MEASURES_PROPERTY", "PRODUCES_CONCLUSION")


def path_nodes(nodes: DataFrame, edges: DataFrame, experiments: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors, experiments, their chain neighbours and both ends of contradictions."""
    exp = experiments.select("id")
    near = edges.filter(F.col("type").isin(*PATH_RELATIONS)).join(exp.withColumnRenamed("id", "source"), "source", "left_semi")
    conclusions = near.filter(F.col("type") == "PRODUCES_CONCLUSION").select(F.col("target").alias("id"))
    clash = contradictions(nodes, edges, conclusions).select(F.explode(F.array("a_id", "b_id")).alias("id"))
    return exp.unionByName(anchors.select("id")).unionByName(near.select(F.col("target").alias("id"))).unionByName(clash).distinct()


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of a known type with both ends present."""
    types = F.broadcast(relation_type_table(edges.sparkSession))
    return edges_within(edges.join(types, "type", "left_semi"), nodes.select("id"))
