"""Entity resolution, validation, fact versions and review pairs."""

from __future__ import annotations

import difflib
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evigraph.functions.skew import previous_value, spread_join
from evigraph.functions.text import safe_slug, stable_id
from evigraph.model import (
    CONFIDENCE_EXTERNAL, CONFIDENCE_HIGH, CONFIDENCE_LOW, CONFIDENCE_MEDIUM, NON_FACT_KEYS,
    NUMERIC_EVIDENCE_SUFFIXES, UNTITLED, VERIFICATION_FIELDS, VERIFIED_TYPES, signature_table,
)
from evigraph.operators.components import components
from evigraph.operators.graph import id_range
from evigraph.operators.matching import similar_names
from evigraph.session import cut_lineage, cut_to_table

# Fixed values.
SAME_ENTITY = 0.75
REVIEW_RANGE = (0.2, 0.85)
REVIEW_NOTE = "Похожая комбинация материал+процесс, требует ручной проверки эксперта"
EXTERNAL_LINK = "MENTIONS"
SOURCE_ISSUE = "%s: источник должен быть %s, получено %s"
TARGET_ISSUE = "%s: цель должна быть %s, получено %s"


def folded(name: Column) -> Column:
    return F.lower(F.trim(name))


def alias_table(nodes: DataFrame) -> DataFrame:
    """aliases(type, lname, node_id): the first node of each folded name."""
    return nodes.groupBy("type", folded(F.col("name")).alias("lname")).agg(F.min("id").alias("node_id"))


def resolve_exact(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """mentions + node_id, null where no alias has the folded name. A frequent name is spread."""
    keyed = mentions.withColumn("lname", folded(F.col("name")))
    return spread_join(keyed, aliases.select("type", "lname", "node_id"), ["type", "lname"], "left")


def resolve_fuzzy(names: DataFrame, aliases: DataFrame, threshold: float = SAME_ENTITY) -> DataFrame:
    """(type, lname, node_id, score): best similar alias of names without an exact one."""
    fresh = names.select("type", "lname").distinct().join(aliases, ["type", "lname"], "left_anti")
    pairs = similar_names(fresh, aliases, threshold)
    ids = aliases.select("type", F.col("lname").alias("old_lname"), "node_id")
    # Highest score, the earliest node on ties; combined map-side.
    return (
        pairs.join(ids, ["type", "old_lname"])
        .groupBy("type", "lname").agg(F.min(F.struct((-F.col("score")).alias("neg"), "node_id")).alias("b"))
        .select("type", "lname", F.col("b.node_id").alias("node_id"), (-F.col("b.neg")).alias("score"))
    )


PLAIN_ROUNDS = 3
GROUP_LINKS = 200_000  # links that one task reads at once when it decides names in order


def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    """States of the names of one group, taken in order.

    A row is a link of an open name to an open earlier one of the group (``old_lname``), or stands for all its links
    out of the group (null): ``led`` if one of them is a leader, ``outside`` if one is open. A name that depends on an
    open outside one stays open, everything else is final.
    """
    links: dict[tuple, list] = {}
    for row in rows.sort_values(["pos", "lname"], kind="stable").itertuples():
        links.setdefault((row.type, row.lname), []).append(row)
    state: dict[tuple, str] = {}
    for name, lines in links.items():
        seen = {state.get((name[0], row.old_lname), "U") for row in lines if row.old_lname is not None}
        if "L" in seen or any(row.led for row in lines):
            state[name] = "F"
        else:
            state[name] = "U" if "U" in seen or any(row.outside for row in lines) else "L"
    decided = [(*name, to) for name, to in state.items()]
    return pd.DataFrame(decided, columns=["type", "lname", "decided"])


def _settle(status: DataFrame, before: DataFrame) -> DataFrame:
    """``status`` after one plain round: open names whose earlier ones are known are decided."""
    key = ["type", "lname"]
    live = (
        before.join(status.filter("state = 'U'").select(*key), key, "left_semi")
        .join(status.select("type", F.col("lname").alias("old_lname"), F.col("state").alias("old_state")), ["type", "old_lname"])
        .filter("old_state <> 'F'")
        .groupBy(*key).agg(F.max(F.col("old_state") == "L").alias("has_leader"))
    )
    return cut_to_table(
        status.join(live, key, "left").select(
            *key, "pos",
            F.when(F.col("state") != "U", F.col("state")).when(F.col("has_leader").isNull(), "L").when(F.col("has_leader"), "F").otherwise("U").alias("state"),
        )
    )


def _groups(status: DataFrame, before: DataFrame, group_links: int) -> DataFrame:
    """(type, lname, pos, group): open names by component of their links.

    A component of more links than one task should read is cut into runs of its own order.
    """
    key = ["type", "lname"]
    node = F.xxhash64("type", "lname")
    still = status.filter("state = 'U'").select(*key, "pos", node.alias("node"))
    # Links between open names only: decided ones no longer hold anything back.
    ends = before.join(still.select(*key), key, "left_semi").join(still.select("type", F.col("lname").alias("old_lname")), ["type", "old_lname"], "left_semi")
    links = ends.select(node.alias("a"), F.xxhash64("type", "old_lname").alias("b"))
    placed = still.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    degree = links.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    # Running sums per component: over ranges of positions first, so that no component is sorted in one task.
    sized = placed.join(degree, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    sized = cut_to_table(sized.withColumn("range", F.floor(F.col("pos") / group_links)))
    totals = sized.groupBy("label", "range").agg(F.sum("n").alias("held"))
    earlier = totals.select(
        "label", "range", F.coalesce(F.sum("held").over(W.partitionBy("label").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead")
    )
    inside = F.sum("n").over(W.partitionBy("label", "range").orderBy("pos", "lname").rowsBetween(W.unboundedPreceding, 0))
    run = F.floor((F.col("ahead") + F.col("inside") - 1) / group_links)
    return sized.withColumn("inside", inside).join(earlier, ["label", "range"]).select(*key, "pos", F.xxhash64("label", run).alias("group"))


def leaders(names: DataFrame, pairs: DataFrame, plain_rounds: int = PLAIN_ROUNDS, group_links: int = GROUP_LINKS) -> DataFrame:
    """Names that become nodes when mentions are read in order: (type, lname, pos).

    ``names(type, lname, pos, fixed)`` with the first position of each name (``fixed`` names are
    nodes already); ``pairs(type, lname, old_lname)`` are similar names. A name follows if an
    earlier leader is similar to it. A few plain rounds decide every name whose earlier ones are
    decided. What is left hangs on chains of names: its links fall into components, independent of each
    other, and the names of one component are decided in order inside one task. Only a component of more
    than ``group_links`` links is cut into runs of its order, which take a round for each run that a
    chain crosses. The number of rounds so grows with the logarithm of the names, not with the
    longest chain, and the result is exactly the sequential one.
    """
    key = ["type", "lname"]
    place = names.select(*key, F.struct("pos", "lname").alias("at"))
    before = (
        pairs.join(place, key)
        .join(place.select("type", F.col("lname").alias("old_lname"), F.col("at").alias("old_at")), ["type", "old_lname"])
        .filter(F.col("old_at") < F.col("at")).select(*key, "old_lname")
    )
    before = cut_to_table(before)
    status = cut_to_table(
        names.join(before.select(*key).distinct().withColumn("waits", F.lit(True)), key, "left").select(
            *key, "pos", F.when(F.col("fixed") | F.col("waits").isNull(), "L").otherwise("U").alias("state")
        )
    )
    rounds = 0
    open_names = status.filter("state = 'U'")
    while rounds < plain_rounds and not open_names.isEmpty():
        status = _settle(status, before)
        open_names = status.filter("state = 'U'")
        rounds += 1
    if open_names.isEmpty():
        return status.filter("state = 'L'").select(*key, "pos")

    grouped = cut_to_table(_groups(status, before, group_links))
    old_groups = grouped.select("type", F.col("lname").alias("old_lname"), F.col("group").alias("old_group"))
    while not open_names.isEmpty():
        mine = grouped.join(open_names.select(*key), key, "left_semi")
        states = status.select("type", F.col("lname").alias("old_lname"), F.col("state").alias("old_state"))
        live = before.join(states, ["type", "old_lname"]).filter("old_state <> 'F'").join(old_groups, ["type", "old_lname"], "left")
        waits = F.col("old_state") == "U"
        # Links out of the group are one row per name before they travel.
        near = waits & (F.col("old_group") == F.col("group"))
        linked = mine.join(live, key, "left").withColumn("near", F.coalesce(near, F.lit(False)))
        rows = linked.groupBy(*key, "pos", "group", F.when(F.col("near"), F.col("old_lname")).alias("old_lname")).agg(
            F.max(F.coalesce(F.col("old_state") == "L", F.lit(False))).alias("led"),
            F.max(F.coalesce(waits & ~F.col("near"), F.lit(False))).alias("outside"),
        )
        solved = rows.groupBy("group").applyInPandas(_decide, "type string, lname string, decided string")
        status = cut_to_table(
            status.join(solved, key, "left").select(*key, "pos", F.when(F.col("state") == "U", F.coalesce("decided", "state")).otherwise(F.col("state")).alias("state"))
        )
        open_names = status.filter("state = 'U'")
    return status.filter("state = 'L'").select(*key, "pos")


def resolve_batch(mentions: DataFrame, existing: DataFrame | None = None, threshold: float = SAME_ENTITY) -> DataFrame:
    """mentions(type, name, pos, ...) + lname, leader, entity_id, as if read one after another.

    A mention joins the most similar node created before it (an equal name first, the earliest on
    ties), else its name becomes a node. Order is (pos, folded name).
    """
    keyed = mentions.withColumn("lname", folded(F.col("name")))
    names = keyed.groupBy("type", "lname").agg(F.min("pos").alias("pos")).withColumn("fixed", F.lit(False))
    if existing is not None:
        old = existing.select("type", folded(F.col("name")).alias("lname"), F.lit(-1).cast("long").alias("pos"), F.lit(True).alias("fixed")).distinct()
        names = names.unionByName(old).groupBy("type", "lname").agg(F.min("pos").alias("pos"), F.max("fixed").alias("fixed"))
    names = cut_lineage(names)
    pairs = cut_lineage(similar_names(names, names, threshold).filter("lname <> old_lname"))
    lead = cut_lineage(leaders(names, pairs))

    # For each follower name the leaders similar to it, reduced to those that beat all earlier ones:
    # between two such records the best leader does not change.
    mine = W.partitionBy("type", "lname").orderBy("at")
    records = (
        pairs.join(lead.select("type", F.col("lname").alias("old_lname"), F.struct(F.col("pos"), F.col("lname")).alias("at")), ["type", "old_lname"])
        .join(lead.select("type", "lname"), ["type", "lname"], "left_anti")
        .withColumn("best_before", F.max("score").over(mine.rowsBetween(W.unboundedPreceding, -1)))
        .filter(F.col("best_before").isNull() | (F.col("score") > F.col("best_before")))
        .withColumn("until", F.lead("at").over(mine))
        .select("type", "lname", F.col("old_lname").alias("leader"), "at", "until")
    )
    own = lead.select("type", "lname", F.col("lname").alias("leader"), F.lit(None).cast("struct<pos:bigint,lname:string>").alias("at"), F.lit(None).cast("struct<pos:bigint,lname:string>").alias("until"))
    here = F.struct("pos", "lname")
    return (
        spread_join(keyed, own.unionByName(records), ["type", "lname"])
        .filter((F.col("at").isNull() | (F.col("at") < here)) & (F.col("until").isNull() | ~(F.col("until") < here)))
        .drop("at", "until")
        .withColumn("entity_id", stable_id(F.col("type"), F.col("leader")))
    )


def resolve_relation_endpoints(rel_mentions: DataFrame, entities: DataFrame, publications: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, ord, source, target, type): temporary ids replaced, unresolved dropped.

    ``entities(doc_id, chunk_no, ord, tmp_id, entity_id)``: a repeated tmp_id means its last
    mention. ``publications(doc_id, pub_id)`` answers the reserved id ``pub`` in every chunk.
    """
    ids = (
        entities.groupBy("doc_id", "chunk_no", "tmp_id").agg(F.max(F.struct("ord", "entity_id")).alias("m"))
        .select("doc_id", "chunk_no", "tmp_id", F.col("m.entity_id").alias("real"))
    )
    pub = publications.select("doc_id", "pub_id")
    keys = ["doc_id", "chunk_no"]

    def end(df: DataFrame, tmp: str, out: str) -> DataFrame:
        side = ids.select(*keys, F.col("tmp_id").alias(tmp), F.col("real").alias("_r"))
        got = df.join(side, [*keys, tmp], "left")
        return got.withColumn(out, F.when(F.col(tmp) == "pub", F.col("pub_id")).otherwise(F.col("_r"))).drop("_r").filter(F.col(out).isNotNull())

    both = end(end(rel_mentions.join(pub, "doc_id", "left"), "source_tmp", "source"), "target_tmp", "target")
    return both.select(*keys, "ord", "source", "target", "type")


def validate_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges + accepted, issues: end types against the signature of the relation."""
    # The nodes, not the far more numerous edges, are what a task holds: no edge is sorted.
    types = nodes.select("id", "type").hint("shuffle_hash")
    typed = edges.join(types.select(F.col("id").alias("source"), F.col("type").alias("source_type")), "source").join(
        types.select(F.col("id").alias("target"), F.col("type").alias("target_type")), "target"
    )
    checked = typed.join(F.broadcast(signature_table(edges.sparkSession)), "type", "left")
    none = F.array().cast("array<string>")
    # Joined arrays instead of a filter over one, whose lambda would be interpreted for every edge.
    issues = F.concat(
        F.when(F.col("want_source").isNull(), F.array(F.concat(F.lit("Неизвестный тип связи "), "type"))).otherwise(none),
        F.when(F.col("source_type") != F.col("want_source"), F.array(F.format_string(SOURCE_ISSUE, "type", "want_source", "source_type"))).otherwise(none),
        F.when(~F.array_contains("want_targets", F.col("target_type")), F.array(F.format_string(TARGET_ISSUE, "type", F.array_join("want_targets", "/"), "target_type"))).otherwise(none),
    )
    return checked.withColumn("issues", issues).withColumn("accepted", F.size("issues") == 0).drop("want_source", "want_targets")


def validate_verification_fields(nodes: DataFrame) -> DataFrame:
    """(id, type, field): verification fields that are missing or empty."""
    missing = F.filter(
        F.array(*[F.when(F.coalesce(F.col(f), F.lit("")) == "", f) for f in VERIFICATION_FIELDS]), lambda f: f.isNotNull()
    )
    return nodes.filter(F.col("type").isin(*VERIFIED_TYPES)).select("id", "type", F.explode(missing).alias("field"))


def edge_upsert(edges: DataFrame) -> DataFrame:
    """Long form (source, target, type, key, value): one edge per triple, later attributes win.

    ``edges(source, target, type, attrs_str, seq)``. An edge without attributes keeps a null key.
    """
    attrs = edges.select("source", "target", "type", "seq", F.explode_outer("attrs_str").alias("key", "value"))
    last = attrs.groupBy("source", "target", "type", "key").agg(F.max_by("value", "seq").alias("value"))
    # The null-key row only stands for an edge that never had an attribute.
    edge = W.partitionBy("source", "target", "type")
    return last.withColumn("n", F.count("key").over(edge)).filter(F.col("key").isNotNull() | (F.col("n") == 0)).drop("n")


def fact_rows(mentions: DataFrame, *also: str) -> DataFrame:
    """(entity_id, attr, value, source_file, doc_id, pos) of every attribute of resolved mentions, + columns ``also``.

    ``value`` is a struct(num, text) with one field set: numbers come from the map ``attrs_num``, texts from
    ``attrs_str`` (either may be missing or null). A number never equals a text, and 2 equals 2.0.
    """
    # Zipped arrays instead of transformed entries, whose lambda would be interpreted for every fact.
    def typed(name: str, field: str) -> Column:
        values = F.map_values(name)
        num = values.cast("array<double>") if field == "num" else F.array().cast("array<double>")
        text = values.cast("array<string>") if field == "text" else F.array().cast("array<string>")
        return F.coalesce(F.arrays_zip(F.map_keys(name).alias("attr"), num.alias("num"), text.alias("text")).cast(entries), F.array().cast(entries))

    entries = "array<struct<attr:string,num:double,text:string>>"
    given = [typed(name, field) for name, field in (("attrs_num", "num"), ("attrs_str", "text")) if name in mentions.columns]
    rows = mentions.select("entity_id", "source_file", "doc_id", "pos", *also, F.explode(F.concat(*given)).alias("fact"))
    stated = F.col("fact.num").isNotNull() | F.col("fact.text").isNotNull()
    return rows.filter(stated & ~F.col("fact.attr").isin(*NON_FACT_KEYS)).select(
        "entity_id", "fact.attr", F.struct(F.col("fact.num").alias("num"), F.col("fact.text").alias("text")).alias("value"), "source_file", "doc_id", "pos", *also
    )


DOCS_PER_RANGE = 4096


def fact_history(facts: DataFrame, docs_per_bucket: int = DOCS_PER_RANGE) -> DataFrame:
    """(entity_id, attr, old_value, new_value, source_file, pos): each change of a value, or of its type, in order.

    The history of one entity is split into document ranges, so a fact stated by a large share of
    all documents is not sorted in one task. A column ``doc_range`` of the facts is taken as that range.
    """
    order = ["pos", "value", "source_file"]
    bucket = F.col("doc_range") if "doc_range" in facts.columns else F.floor(F.col("doc_id") / docs_per_bucket)
    seen = previous_value(facts, ["entity_id", "attr"], order, bucket, "value", "old_value")
    return seen.filter(F.col("old_value").isNotNull() & (F.col("old_value") != F.col("value"))).select(
        "entity_id", "attr", "old_value", F.col("value").alias("new_value"), "source_file", "pos"
    )


def mention_history(mentions: DataFrame, docs_per_bucket: int = DOCS_PER_RANGE) -> DataFrame:
    """``fact_history`` of the facts of mentions, which are shuffled before each of them becomes several facts."""
    ranged = mentions.withColumn("doc_range", F.floor(F.col("doc_id") / docs_per_bucket))
    return fact_history(fact_rows(ranged.repartition("entity_id", "doc_range"), "doc_range"))


def current_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("entity_id", "attr").agg(F.max(F.struct("pos", "value", "source_file")).alias("m")).select(
        "entity_id", "attr", F.col("m.value").alias("value"), F.col("m.source_file").alias("source_file")
    )


def source_accumulation(mentions: DataFrame) -> DataFrame:
    """(entity_id, source_file, first_pos): distinct sources, ordered by first appearance."""
    return mentions.groupBy("entity_id", "source_file").agg(F.min("pos").alias("first_pos"))


def is_numeric_evidence(key: Column) -> Column:
    return key.rlike("(?:" + "|".join(NUMERIC_EVIDENCE_SUFFIXES) + ")$")


def confidence_label(has_numeric: Column, n_sources: Column) -> Column:
    return (
        F.when(has_numeric & (n_sources >= 2), CONFIDENCE_HIGH)
        .when(~has_numeric & (n_sources <= 1), CONFIDENCE_LOW)
        .otherwise(CONFIDENCE_MEDIUM)
    )


def infer_confidence(mentions: DataFrame) -> DataFrame:
    """(entity_id, n_sources, has_numeric, confidence); sources are combined before they are counted."""
    numeric = F.exists(F.map_keys("attrs_num"), is_numeric_evidence)
    per_source = mentions.groupBy("entity_id", "source_file").agg(F.max(F.coalesce(numeric, F.lit(False))).alias("num"))
    per_entity = per_source.groupBy("entity_id").agg(F.count("source_file").alias("n_sources"), F.max("num").alias("has_numeric"))
    return per_entity.withColumn("confidence", confidence_label(F.col("has_numeric"), F.col("n_sources")))


def review_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a_id, b_id): conclusions of two experiments that share a material and a process.

    Unordered pairs, smaller id first, without pairs that an edge already joins. Only edges of experiments with a
    conclusion, and edges whose ends lie between the first and the last conclusion, leave the scan.
    """
    def links(rel: str, name: str) -> DataFrame:
        return edges.filter(F.col("type") == rel).select(F.col("source").alias("exp"), F.col("target").alias(name))

    produced = cut_to_table(links("PRODUCES_CONCLUSION", "concl"))
    exps, concls = id_range(produced, "exp"), id_range(produced, "concl")
    inside = lambda name, rel: links(rel, name).filter(exps(F.col("exp")))
    keyed = cut_lineage(produced.join(inside("mat", "USES_MATERIAL"), "exp").join(inside("proc", "USES_PROCESS"), "exp"))
    left = keyed.select("mat", "proc", F.col("exp").alias("exp_a"), F.col("concl").alias("a_id"))
    right = keyed.select("mat", "proc", F.col("exp").alias("exp_b"), F.col("concl").alias("b_id"))
    pairs = spread_join(left, right, ["mat", "proc"]).filter((F.col("a_id") < F.col("b_id")) & (F.col("exp_a") != F.col("exp_b"))).select("a_id", "b_id").distinct()
    # An edge between two conclusions starts at one of them and ends at one.
    ends = edges.select("source", "target").filter(concls(F.col("source")) & concls(F.col("target")))
    between = ends.join(produced.select(F.col("concl").alias("source")).distinct(), "source", "left_semi")
    joined = between.select(F.least("source", "target").alias("a_id"), F.greatest("source", "target").alias("b_id"))
    return pairs.join(joined, ["a_id", "b_id"], "left_anti")


def ratio_from(low: float, a: str, b: str) -> float | None:
    """difflib's ratio of two texts, None as soon as it is sure to be below ``low``.

    Matching blocks are looked for in the widest open stretch first. What is open can match its shorter side at most,
    so most pairs are given up after a few blocks; a ratio that is returned is exactly difflib's.
    """
    matcher = difflib.SequenceMatcher(None, a, b)
    length = len(a) + len(b)
    if not length:
        return matcher.ratio()
    # Common characters bound the matches, too.
    if matcher.quick_ratio() < low:
        return None
    matched, left = 0, min(len(a), len(b))
    stretches = [(-left, 0, len(a), 0, len(b))]
    while stretches:
        if 2.0 * (matched + left) / length < low:
            return None
        room, a_low, a_high, b_low, b_high = heapq.heappop(stretches)
        left += room
        i, j, size = matcher.find_longest_match(a_low, a_high, b_low, b_high)
        if not size:
            continue
        matched += size
        for part in ((a_low, i, b_low, j), (i + size, a_high, j + size, b_high)):
            fits = min(part[1] - part[0], part[3] - part[2])
            if fits > 0:
                left += fits
                heapq.heappush(stretches, (-fits, *part))
    return 2.0 * matched / length


def needs_review_pairs(nodes: DataFrame, edges: DataFrame, similarity_range: tuple[float, float] = REVIEW_RANGE) -> DataFrame:
    """NEEDS_REVIEW edges: candidates whose texts are moderately similar.

    Lengths bound the ratio from above, so hopeless pairs are dropped before any text is compared;
    equal text pairs are compared once.
    """
    low, high = similarity_range
    names = nodes.filter("type = 'conclusion'").select("id", "name").filter("name <> ''")
    pairs = (
        review_candidates(nodes, edges)
        .join(names.select(F.col("id").alias("a_id"), F.col("name").alias("a_name")), "a_id")
        .join(names.select(F.col("id").alias("b_id"), F.col("name").alias("b_name")), "b_id")
        .filter(2 * F.least(F.length("a_name"), F.length("b_name")) >= low * (F.length("a_name") + F.length("b_name")))
    )
    # Comparing texts costs far more than their bytes suggest: a fixed number of tasks keeps all cores busy.
    spark = nodes.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = cut_lineage(pairs)
    distinct = pairs.select("a_name", "b_name").distinct().repartition(tasks, "a_name", "b_name")
    # Kept from being copied into pushed-down filters, where each pair would be compared again.
    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio_from(low, x, y) for x, y in zip(a, b)], dtype="float64")

    rated = distinct.withColumn("ratio", ratio.asNondeterministic()("a_name", "b_name")).filter(F.col("ratio").between(low, high))
    return pairs.join(rated, ["a_name", "b_name"]).select(
        F.col("a_id").alias("source"), F.col("b_id").alias("target"), F.lit("NEEDS_REVIEW").alias("type"),
        F.round("ratio", 2).alias("similarity"), F.lit(REVIEW_NOTE).alias("note"),
    )


def pipeline_stats(resolved: DataFrame, checked_edges: DataFrame | None = None) -> DataFrame:
    """Per document: entities created and reused (and accepted relations, warnings if given)."""
    first = resolved.groupBy("type", "leader").agg(F.min(F.struct("pos", "lname", "doc_id")).alias("f"))
    created = first.groupBy(F.col("f.doc_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("created"))
    total = resolved.groupBy("doc_id").agg(F.count(F.lit(1)).alias("mentions"))
    out = total.join(created, "doc_id", "left").select(
        "doc_id", F.coalesce("created", F.lit(0)).cast("long").alias("created"),
        (F.col("mentions") - F.coalesce("created", F.lit(0))).cast("long").alias("reused"),
    )
    if checked_edges is None:
        return out
    rel = checked_edges.groupBy("doc_id").agg(F.count_if("accepted").alias("relations"), F.sum(F.size("issues")).alias("warnings"))
    return out.join(rel, "doc_id", "left").fillna(0, ["relations", "warnings"])


def external_publication_id(kind: Column, url: Column, title: Column) -> Column:
    basis = F.coalesce(F.nullif(url, F.lit("")), title, F.lit(""))
    slug = F.trim(safe_slug(basis), F.lit("_"))
    return F.concat(F.lit("rg_ext_"), kind, F.lit("_"), F.when(slug != "", slug).otherwise(F.substring(F.sha1(basis), 1, 16)))


def external_mentions(sources: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(publications, MENTIONS edges) of external sources.

    ``sources(kind, title, url, year, rank, matched_keywords)``. Sources without title and url are
    skipped; the first of equal ids stays. A keyword links to one entity of that folded name (the
    largest id where several share it).
    """
    usable = sources.filter((F.coalesce(F.trim("title"), F.lit("")) != "") | (F.coalesce("url", F.lit("")) != ""))
    ided = usable.withColumn("id", external_publication_id(F.col("kind"), F.col("url"), F.col("title")))
    cols = [c for c in ided.columns if c not in ("id", "rank")]
    first = ided.groupBy("id").agg(F.min_by(F.struct(*cols), "rank").alias("s")).select("id", "s.*")
    pubs = first.select(
        "id", F.lit("publication").alias("type"),
        F.when(F.coalesce(F.trim("title"), F.lit("")) != "", F.trim("title")).otherwise(UNTITLED).alias("name"),
        F.coalesce(F.col("year").cast("string"), F.lit("")).alias("date"), F.lit(CONFIDENCE_EXTERNAL).alias("confidence"), F.col("kind").alias("origin"),
    )
    targets = nodes.filter((F.col("type") != "publication") & (F.coalesce("name", F.lit("")) != "")).groupBy(F.lower("name").alias("lkw")).agg(F.max("id").alias("target"))
    links = (
        first.select(F.col("id").alias("source"), F.explode("matched_keywords").alias("keyword"))
        .withColumn("lkw", F.lower("keyword")).join(targets, "lkw")
        .groupBy("source", "target").agg(F.min("keyword").alias("keyword"))
        .withColumn("type", F.lit(EXTERNAL_LINK))
    )
    return pubs, links


def session_graph_stats(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counts for a result graph."""
    n = nodes.agg(
        F.count_if(F.col("type") != "publication").alias("entities"), F.count_if(F.col("type") == "publication").alias("publications"),
        F.count_if(F.col("origin").isNotNull()).alias("external_pubs"),
    )
    e = edges.agg(F.count(F.lit(1)).alias("relations"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    return n.select("*", e.scalar().alias("relations"), c.scalar().alias("chunks"))
