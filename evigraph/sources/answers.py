"""Answer export: one JSON object or one Markdown text per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.model import CHAIN_STEPS
from evigraph.operators.graph import experiment_chains
from evigraph.session import cut_to_table

STEPS = list(CHAIN_STEPS)
STEP_LABELS = {"material": "Материал", "process": "Процесс", "equipment": "Оборудование", "result": "Результат"}
NO_EXTERNAL = "По данным ключевым словам релевантные публикации и патенты не найдены"
EXTERNAL_HEADS = {"scholar": ("S", "Google Scholar — научные публикации"), "patent": ("P", "Google Patents — патенты")}


def _joined(*parts) -> Column:
    """Texts behind each other, a missing one as nothing."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def question_chains(cited: DataFrame, nodes: DataFrame, edges: DataFrame, publication_id: Column) -> DataFrame:
    """(qset_id, experiment_id, ...) as ``graph.experiment_chains`` gives them, for the experiments that a question's
    cited documents describe. ``publication_id`` names the node of a cited document.

    The described experiments and their edges are stored, so that the joins know how few they are.
    """
    pubs = cut_to_table(cited.select("qset_id", publication_id.alias("source")).distinct())
    described = edges.filter(F.col("type") == "DESCRIBES_EXPERIMENT").select("source", F.col("target").alias("experiment_id"))
    asked = cut_to_table(described.join(pubs, "source").select("qset_id", "experiment_id").distinct())
    exps = asked.select("experiment_id")
    own = edges.join(exps.withColumnRenamed("experiment_id", "source"), "source", "left_semi")
    into = edges.filter(F.col("type") == "DESCRIBES_EXPERIMENT").join(exps.withColumnRenamed("experiment_id", "target"), "target", "left_semi")
    near = cut_to_table(own.select("source", "target", "type").unionByName(into.select("source", "target", "type")))
    return experiment_chains(nodes, near).join(asked, "experiment_id")


def chains_of_questions(chains: DataFrame) -> DataFrame:
    """(qset_id, chains): an array with a chain per experiment, its four steps with their items, by publication and name.

    The items of one experiment are few; properties stand before conclusions.
    """
    item = F.struct("step_no", (F.col("kind") == "conclusion").alias("late"), "item_id", F.col("item_name").alias("name"), "kind")
    per = chains.groupBy("qset_id", "experiment_id", "experiment_name", "publication_id", "publication_name").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(no: int, key: str) -> Column:
        own = F.transform(
            F.filter("items", lambda i: i["step_no"] == no),
            lambda i: F.struct(i["item_id"].alias("id"), i["name"].alias("name"), i["kind"].alias("kind")),
        )
        return F.struct(F.lit(key).alias("key"), F.lit(STEP_LABELS[key]).alias("label"), own.alias("items"))

    publication = F.when(F.col("publication_id").isNotNull(), F.struct(F.col("publication_id").alias("id"), F.col("publication_name").alias("name")))
    chain = F.struct(
        F.coalesce("publication_name", F.lit("")).alias("by"), F.coalesce("experiment_name", F.lit("")).alias("experiment_name"), "experiment_id",
        publication.alias("publication"), F.array(*[step(no, key) for no, key in enumerate(STEPS)]).alias("steps"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(chain)), lambda c: c.dropFields("by"))
    return per.groupBy("qset_id").agg(ordered.alias("chains"))


def external_of_questions(sources: DataFrame) -> DataFrame:
    """(qset_id, keywords, scholar, patents): the found external sources of a question in their order."""
    fields = ["rank", "title", "authors", "year", "venue", "snippet", "matched_keywords", "relevance"]

    def of(kind: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*fields, "item_id"))))
        return F.transform(found, lambda e: e.dropFields("rank", "item_id")).alias("scholar" if kind == "scholar" else "patents")

    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id", "keywords"))), lambda e: e["keywords"])
    return sources.groupBy("qset_id").agg(F.array_distinct(F.flatten(words)).alias("keywords"), of("scholar"), of("patent"))


def _chain_line(c: Column) -> Column:
    names = lambda s: F.array_join(F.filter(F.transform(s["items"], lambda i: i["name"]), lambda n: F.coalesce(n, F.lit("")) != ""), ", ")
    steps = F.array_join(F.transform(c["steps"], lambda s: F.coalesce(F.nullif(names(s), F.lit("")), F.lit("—"))), " → ")
    experiment = F.when(c["experiment_name"] != "", c["experiment_name"]).otherwise("Эксперимент")
    header = F.when(F.coalesce(c["publication"]["name"], F.lit("")) != "", F.concat(c["publication"]["name"], F.lit(" · "), experiment)).otherwise(experiment)
    return F.concat(F.lit("- **"), header, F.lit(":** "), steps)


def _external_lines(kind: str, column: str) -> Column:
    prefix, head = EXTERNAL_HEADS[kind]

    def line(e: Column, i: Column) -> Column:
        meta = F.array_join(F.filter(F.array(F.array_join(e["authors"], ", "), e["year"].cast("string"), e["venue"]), lambda m: F.coalesce(m, F.lit("")) != ""), " · ")
        title = F.when(F.coalesce(e["title"], F.lit("")) != "", e["title"]).otherwise("(без названия)")
        return F.concat_ws(
            "\n",
            _joined(F.lit(prefix), i + 1, F.lit(". **"), title, F.lit("**"), F.concat(F.lit(" _(релевантность "), e["relevance"].cast("string"), F.lit(")_"))),
            F.when(meta != "", F.concat(F.lit("   "), meta)),
            F.when(e["snippet"] != "", F.concat(F.lit("   > "), F.replace(e["snippet"], F.lit("\n"), F.lit(" ")))),
            F.when(F.size(e["matched_keywords"]) > 0, F.concat(F.lit("   _по словам:_ "), F.array_join(e["matched_keywords"], ", "))),
            F.lit(""),
        )

    return F.when(F.size(column) > 0, F.concat(F.lit(f"### {head}\n\n"), F.array_join(F.transform(column, line), "\n")))


def answer_documents(
    questions: DataFrame, answers: DataFrame, confidence: DataFrame, cited: DataFrame, variants: DataFrame, chains: DataFrame, external: DataFrame
) -> DataFrame:
    """(qset_id, json, markdown): question, other formulations, confidence, chains, answer, numbered citations, external sources.

    ``variants(qset_id, variant_no, text)`` are the formulations searched, ``chains`` is as ``question_chains`` gives it,
    ``external(qset_id, item_id, kind, rank, keywords, title, authors, year, venue, snippet, matched_keywords, relevance)``
    as ``retrieval.external_relevance`` does. Citations are at most top_k per question.
    """
    fields = ["index", "doc_id", "title", "source_type", "source_name", "location", "score", "snippet"]
    per = cited.groupBy("qset_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("citations"))
    other = variants.join(questions.select("qset_id", F.col("text").alias("asked")), "qset_id").filter(F.col("text") != F.col("asked"))
    worded = other.groupBy("qset_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("variant_no", "text"))), lambda v: v["text"])).alias("expansions"))
    rows = questions.join(answers, "qset_id").join(confidence, "qset_id").join(per, "qset_id", "left").join(worded, "qset_id", "left")
    rows = rows.join(chains_of_questions(chains), "qset_id", "left").join(external_of_questions(external), "qset_id", "left")
    arrays = ["citations", "expansions", "chains", "keywords", "scholar", "patents"]
    rows = rows.withColumns({c: F.coalesce(c, F.array()) for c in arrays})
    none_found = (F.size("scholar") == 0) & (F.size("patents") == 0)
    payload = F.to_json(F.struct(
        F.col("text").alias("question"), "answer", "confidence", "grounded", "citations", F.col("expansions").alias("query_expansions"),
        F.col("chains").alias("experiment_chains"),
        F.struct("keywords", "scholar", "patents", F.when(none_found, NO_EXTERNAL).alias("message")).alias("external_sources"),
    ))
    lines = F.transform(
        "citations",
        lambda c: _joined(
            c["index"], F.lit(". **"), c["title"], F.lit("** — "), c["location"], F.lit(" _(сходство "), c["score"], F.lit(")_\n   > "),
            F.replace(c["snippet"], F.lit("\n"), F.lit(" ")), F.lit("\n"),
        ),
    )
    markdown = F.concat_ws(
        "\n",
        F.lit("# Ответ по загруженным документам\n"),
        F.concat(F.lit("**Вопрос:** "), "text", F.lit("\n")),
        F.concat(F.lit("**Достоверность:** "), "confidence", F.lit("\n")),
        F.when(F.size("expansions") > 0, F.concat(F.lit("**Расширенные формулировки поиска:**\n"), F.array_join(F.transform("expansions", lambda q: F.concat(F.lit("- "), q)), "\n"), F.lit("\n"))),
        F.when(F.size("chains") > 0, F.concat(F.lit("**Цепочки (материал → процесс → оборудование → результат):**\n\n"), F.array_join(F.transform("chains", _chain_line), "\n"), F.lit("\n"))),
        F.lit("## Ответ\n"), F.concat("answer", F.lit("\n")),
        F.when(F.size("citations") > 0, F.lit("## Источники\n\n### Внутренняя база знаний (RAG / документы)\n")),
        F.when(F.size("citations") > 0, F.array_join(lines, "\n")),
        _external_lines("scholar", "scholar"), _external_lines("patent", "patents"),
        F.when(none_found, F.lit(f"### Внешние источники\n\n{NO_EXTERNAL}\n")),
    )
    return rows.select("qset_id", payload.alias("json"), markdown.alias("markdown"))


def export_answers(documents: DataFrame, path: str) -> None:
    """Text files in folders per question, written by all tasks."""
    documents.select("qset_id", F.col("json").alias("value")).write.mode("overwrite").partitionBy("qset_id").text(f"{path}/json")
    documents.select("qset_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("qset_id").text(f"{path}/markdown")
