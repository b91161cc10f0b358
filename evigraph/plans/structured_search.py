"""Structured questions: from question texts to experiments, gaps, contradictions and answer lines."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.skew import spread_join
from evigraph.model import ANCHOR_RELATION
from evigraph.operators import graph as G
from evigraph.operators import questions as Q
from evigraph.operators.matching import find_by_names
from evigraph.session import cut_lineage, cut_to_table

# Answer texts.
SINGLE_TYPES = ("condition", "property", "equipment", "facility")
COMBO_LABELS = {"material": "материал", "process": "процесс", "condition": "условие", "equipment": "оборудование", "facility": "предприятие"}
GAP_TEXT = (
    "По запрошенной комбинации (%s)%s экспериментов и публикаций в базе не найдено — "
    "это похоже на пробел в данных, требующий отдельного исследования или запроса внешних источников."
)
GAP_CONSTRAINTS = " при ограничениях %s"
NOT_RECOGNISED_TEXT = (
    "Не удалось распознать материал/процесс/условие/свойство в вопросе. "
    "Попробуйте конкретнее, например: «Какие методы обессоливания подходят при сульфатах "
    "200-300 мг/л и требуемом сухом остатке ≤1000 мг/дм³?»"
)
NUMBERS_ONLY_GAP = "числовые ограничения без совпадений"
CONTRADICTION_HEAD = "⚠ ОБНАРУЖЕНО ПРОТИВОРЕЧИЕ В ВЫВОДАХ:"
CONTRADICTION_TEXT = "  • «%s» ПРОТИВОРЕЧИТ «%s». %s"
LINE_TEXT = (
    "[%s] (%s, достоверность: %s) Материал: %s; Процесс: %s; Условие: %s; Оборудование: %s; "
    "Предприятие: %s. Эффект: %s. Вывод: %s. Источник: %s. Команда: %s."
)
NO_VALUE = "—"


@dataclass
class SearchSettings:
    as_of: datetime.date
    synonyms: dict[str, str] = field(default_factory=lambda: dict(Q.SYNONYMS))
    attr_terms: tuple[tuple[str, str], ...] = Q.ATTR_TERMS
    countries: dict[str, str] = field(default_factory=lambda: dict(Q.COUNTRY_PATTERNS))
    years_pattern: str = Q.YEARS_PATTERN


def understand(questions: DataFrame, settings: SearchSettings) -> DataFrame:
    """questions + expanded text, country, cutoff and numeric predicates; one projection."""
    # Parsing costs far more than its bytes suggest, so small question tables are spread out first.
    cores = questions.sparkSession.sparkContext.defaultParallelism
    expanded = questions.repartition(cores, "question_id").select("question_id", Q.expand_synonyms(F.col("text"), settings.synonyms).alias("text"))
    return expanded.select(
        "question_id", "text",
        Q.detect_country(F.col("text"), settings.countries).alias("country"),
        Q.detect_year_cutoff(F.col("text"), settings.as_of, settings.years_pattern).alias("cutoff"),
        Q.extract_numeric_filters(F.col("text"), settings.attr_terms).alias("filters"),
    )


def prepare(nodes: DataFrame, questions: DataFrame, settings: SearchSettings) -> tuple[DataFrame, DataFrame]:
    """(asked, anchors), both stored: later steps read them many times and they are question-sized."""
    asked = cut_lineage(understand(questions, settings))
    return asked, cut_lineage(anchors(nodes, asked))


def anchors(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Best entity matches per question and anchor type."""
    types = list(ANCHOR_RELATION)
    scored = Q.match_entities(asked, cut_lineage(Q.name_table(nodes, types)))
    return Q.best_matches(scored, nodes.filter(F.col("type").isin(*types)), {t: 1 for t in SINGLE_TYPES})


def _passes(exp: str, q: str) -> Column:
    """Country, date and numeric constraints of a question on an experiment."""
    e, a = (lambda c: F.col(f"{exp}.{c}")), (lambda c: F.col(f"{q}.{c}"))
    numeric = F.forall(a("filters"), lambda p: G.compare(e("attrs_num")[p["key"]], p["op"], p["value"]))
    country = a("country").isNull() | F.coalesce(F.upper(e("country")) == F.upper(a("country")), F.lit(False))
    return numeric & country & (a("cutoff").isNull() | (F.coalesce(e("date"), F.lit("")) >= a("cutoff")))


def matched_experiments(nodes: DataFrame, edges: DataFrame, asked: DataFrame, anchor_rows: DataFrame) -> DataFrame:
    """(question_id, experiment_id) for a batch of questions.

    Slots are matched on distinct names. Each question walks in from its rarest slot; its other
    slots and constraints are checked on those candidates only. A question without anchor, number
    and country matches nothing.
    """
    exps = G.entities_by_type(nodes, "experiment").select("id", "country", "date", "attrs_num")
    relation = F.lit(None).cast("string")
    for etype, rel in ANCHOR_RELATION.items():
        relation = F.when(F.col("type") == etype, rel).otherwise(relation)

    picked = anchor_rows.select("question_id", relation.alias("relation"), F.col("lname").alias("query")).distinct()
    targets = nodes.filter(F.col("type").isin(*ANCHOR_RELATION))
    similar = find_by_names(targets, picked.select("query")).select("query", relation.alias("relation"), "lname")
    accepted = cut_lineage(picked.join(similar, ["query", "relation"]).select("question_id", "relation", "lname").distinct())

    # Only edges to names that some question accepts take part: the relations (a handful) leave out the others before
    # edges are shuffled, the names before they are stored.
    used = accepted.select("relation", "lname").distinct()
    asked_relations = F.broadcast(used.select(F.col("relation").alias("type")).distinct())
    ends = targets.select(F.col("id").alias("target"), F.lower("name").alias("lname")).join(used, "lname", "left_semi")
    named = edges.filter(F.col("type").isin(*ANCHOR_RELATION.values())).join(asked_relations, "type", "left_semi").join(
        ends, "target"
    ).join(used.withColumnRenamed("relation", "type"), ["type", "lname"], "left_semi").select(F.col("source").alias("experiment_id"), F.col("type").alias("relation"), "lname")
    named = cut_lineage(named)

    sizes = named.groupBy("relation", "lname").agg(F.count(F.lit(1)).alias("n"))
    slots = picked.select("question_id", "relation").distinct()
    driver = (
        slots.join(accepted.join(sizes, ["relation", "lname"]).groupBy("question_id", "relation").agg(F.sum("n").alias("n")), ["question_id", "relation"], "left")
        .groupBy("question_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "relation")).alias("d"), F.count(F.lit(1)).alias("n_slots"))
        .select("question_id", F.col("d.relation").alias("relation"), "n_slots")
    )
    # Attributes go along with the edge names and constraints with the entry rows, so a candidate
    # is tested the moment it is formed and only survivors are shuffled again.
    entry = accepted.join(driver, ["question_id", "relation"]).join(
        asked.select("question_id", F.struct("country", "cutoff", "filters").alias("q")), "question_id"
    )
    walk = named.join(exps.select(F.col("id").alias("experiment_id"), F.struct("country", "date", "attrs_num").alias("e")), "experiment_id")
    met = spread_join(walk, cut_lineage(entry), ["relation", "lname"])
    checked = met.filter(_passes("e", "q")).select("question_id", "experiment_id", "n_slots", F.col("relation").alias("driver")).distinct()
    checked = cut_lineage(checked)
    single = checked.filter("n_slots = 1").select("question_id", "experiment_id")
    several = (
        checked.filter("n_slots > 1")
        .join(accepted, "question_id").filter("relation <> driver")
        .join(named, ["experiment_id", "relation", "lname"], "left_semi")
        .groupBy("question_id", "experiment_id", "n_slots").agg(F.count_distinct("relation").alias("n"))
        .filter("n = n_slots - 1").select("question_id", "experiment_id")
    )
    # Only numbers or a country given: an equi join on the country, or on the attribute names.
    free = asked.join(slots.select("question_id").distinct(), "question_id", "left_anti")
    e = F.struct("country", "date", "attrs_num").alias("e")
    q = F.struct("country", "cutoff", "filters").alias("q")
    placed = exps.select(F.col("id").alias("experiment_id"), F.upper("country").alias("place"), e)
    asked_place = free.filter(F.col("country").isNotNull()).select("question_id", F.upper("country").alias("place"), q)
    by_country = spread_join(placed, asked_place, ["place"]).filter(_passes("e", "q")).select("question_id", "experiment_id")
    by_number = free.filter(F.col("country").isNull() & (F.size("filters") > 0))
    predicates = by_number.select(F.col("question_id").alias("set_id"), F.explode("filters").alias("p")).select("set_id", "p.*").distinct()
    in_range = G.numeric_range_filter(exps, predicates).select(F.col("set_id").alias("question_id"), F.col("id").alias("experiment_id"))
    numbered = (
        in_range.join(by_number.select("question_id", "cutoff"), "question_id")
        .join(exps.select(F.col("id").alias("experiment_id"), "date"), "experiment_id")
        .filter(F.col("cutoff").isNull() | (F.coalesce("date", F.lit("")) >= F.col("cutoff")))
        .select("question_id", "experiment_id")
    )
    unanchored = by_country.unionByName(numbered)
    return single.unionByName(several).unionByName(unanchored)


def gap_mentions(nodes: DataFrame, asked: DataFrame, anchor_rows: DataFrame, matched: DataFrame) -> DataFrame:
    """(question_id, gap, line) of questions without experiments; gap is null if nothing was recognised."""
    empty = asked.join(matched.select("question_id").distinct(), "question_id", "left_anti")
    first = anchor_rows.filter("rank = 1").filter(F.col("type").isin(*COMBO_LABELS)).select("question_id", "type", "lname")
    # The name as it is written in the graph; of equal names that of the smallest id.
    written = nodes.filter(F.col("type").isin(*COMBO_LABELS)).groupBy("type", F.lower("name").alias("lname")).agg(F.min_by("name", "id").alias("name"))
    first = first.join(written, ["type", "lname"])
    named = first.groupBy("question_id").agg(
        *[F.max(F.when(F.col("type") == t, F.concat(F.lit(f"{label}="), F.col("name")))).alias(t) for t, label in COMBO_LABELS.items()]
    )
    joined = empty.join(named, "question_id", "left")
    combo = F.concat_ws(", ", *[F.col(t) for t in COMBO_LABELS])
    numbers = F.array_join(F.transform("filters", lambda p: F.concat(p["key"], F.lit(" "), p["op"], F.lit(" "), p["value"].cast("string"))), ", ")
    has_numbers = F.size("filters") > 0
    extra = F.when(has_numbers, F.format_string(GAP_CONSTRAINTS, numbers)).otherwise("")
    known = (combo != "") | has_numbers
    return joined.select(
        "question_id",
        F.when(known, F.when(combo != "", combo).otherwise(NUMBERS_ONLY_GAP)).alias("gap"),
        F.when(known, F.format_string(GAP_TEXT, combo, extra)).otherwise(NOT_RECOGNISED_TEXT).alias("line"),
    )


def experiment_lines(nodes: DataFrame, edges: DataFrame, experiments: DataFrame) -> DataFrame:
    """(experiment_id, line): one text per experiment with the names of its neighbours, by node id."""
    rels = ["USES_MATERIAL", "USES_PROCESS", "AT_CONDITION", "ON_EQUIPMENT", "AT_FACILITY", "incoming::DESCRIBES_EXPERIMENT", "CONDUCTED_BY"]
    # Edges that no line names leave where they are derived, among them all but one relation that points at experiments.
    detail = G.experiment_detail(nodes, edges, experiments).filter(F.col("relation").isin(*rels, "PRODUCES_CONCLUSION"))

    def names(rel: str, sep: str = ", ") -> Column:
        pairs = F.collect_list(F.when(F.col("relation") == rel, F.struct("node_id", "node_name")))
        text = F.array_join(F.transform(F.array_sort(pairs), lambda p: p["node_name"]), sep)
        return F.when(text != "", text).otherwise(NO_VALUE)

    texts = detail.groupBy("experiment_id").agg(*[names(r).alias(r) for r in rels], names("PRODUCES_CONCLUSION", "; ").alias("PRODUCES_CONCLUSION"))
    extra = [c for c in ("confidence", "effect") if c in nodes.columns]
    facts = nodes.select(F.col("id").alias("experiment_id"), "country", *extra)
    value = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in ("country", *extra) else F.lit(default)
    return experiments.select(F.col("id").alias("experiment_id")).join(facts, "experiment_id").join(texts, "experiment_id", "left").select(
        "experiment_id",
        F.format_string(
            LINE_TEXT, "experiment_id", value("country", "?"), value("confidence", "?"),
            *[F.coalesce(F.col(f"`{r}`"), F.lit(NO_VALUE)) for r in rels[:5]],
            value("effect", NO_VALUE), F.coalesce("PRODUCES_CONCLUSION", F.lit(NO_VALUE)),
            *[F.coalesce(F.col(f"`{r}`"), F.lit(NO_VALUE)) for r in rels[5:]],
        ).alias("line"),
    )


def question_contradictions(nodes: DataFrame, edges: DataFrame, matched: DataFrame) -> DataFrame:
    """(question_id, a_id, a_name, b_id, b_name, note) for the conclusions of matched experiments."""
    concl = edges.filter("type = 'PRODUCES_CONCLUSION'").select(F.col("source").alias("experiment_id"), F.col("target").alias("id"))
    ids = spread_join(matched, concl, ["experiment_id"]).select("question_id", "id").distinct()
    clash = G.contradictions(nodes, edges, ids.select("id"))
    ends = clash.select(F.explode(F.array("a_id", "b_id")).alias("id"), *clash.columns)
    return ids.join(ends, "id").drop("id").distinct()


def answer_lines(nodes: DataFrame, edges: DataFrame, asked: DataFrame, anchor_rows: DataFrame, matched: DataFrame) -> DataFrame:
    """Long form of the answer text: (question_id, part, key, line), ordered by part and key.

    Part 0 holds experiments or the gap note, part 1 the contradictions.
    """
    lines = experiment_lines(nodes, edges, matched.select(F.col("experiment_id").alias("id")).distinct())
    found = matched.join(lines, "experiment_id").select("question_id", F.lit(0).alias("part"), F.col("experiment_id").alias("key"), "line")
    gaps = gap_mentions(nodes, asked, anchor_rows, matched).select("question_id", F.lit(0).alias("part"), F.lit("").alias("key"), "line")
    # Stored: the heads read it too, and it takes several passes over the edges.
    clash = cut_to_table(question_contradictions(nodes, edges, matched)).select(
        "question_id", F.lit(1).alias("part"), F.concat("a_id", F.lit("|"), "b_id").alias("key"), F.format_string(CONTRADICTION_TEXT, "a_name", "b_name", "note").alias("line")
    )
    heads = clash.select("question_id").distinct().select("question_id", F.lit(1).alias("part"), F.lit("").alias("key"), F.lit(CONTRADICTION_HEAD).alias("line"))
    return found.unionByName(gaps).unionByName(heads).unionByName(clash)


def hybrid_search(nodes: DataFrame, edges: DataFrame, questions: DataFrame, settings: SearchSettings) -> dict[str, DataFrame]:
    """All parts of the answers to a batch of structured questions."""
    asked, anchor_rows = prepare(nodes, questions, settings)
    matched = cut_lineage(matched_experiments(nodes, edges, asked, anchor_rows))
    return {
        "asked": asked,
        "anchors": anchor_rows,
        "matched": matched,
        "gaps": gap_mentions(nodes, asked, anchor_rows, matched),
        "contradictions": question_contradictions(nodes, edges, matched),
        "lines": answer_lines(nodes, edges, asked, anchor_rows, matched),
    }
