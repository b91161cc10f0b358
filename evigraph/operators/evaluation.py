"""Extraction quality, answer ratings and retrieval hit rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import let, name_words, word_match

# Fixed values.
NAME_MATCH = 0.5
RATING_SCALE = "1=неверно, 2=частично, 3=верно с пробелами, 4=верно, 5=эталон"
MARKS = {True: "✓", False: "✗", None: "·"}


def _side(rows: DataFrame, name: str) -> DataFrame:
    item = F.struct("pos", "tmp_id", "type", F.trim(F.lower("name")).alias("lname"), name_words(F.col("name")).alias("words"))
    return rows.groupBy("file_id").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)).alias(name))


def _similarity(p: Column, g: Column) -> Column:
    share = F.size(F.filter(p["words"], lambda w: F.exists(g["words"], lambda v: word_match(w, v)))) / F.size(p["words"])
    same = F.when(p["lname"] == g["lname"], 1.0).otherwise(0.0)
    return F.when((F.size(p["words"]) == 0) | (F.size(g["words"]) == 0), same).otherwise(share)


def entity_matches(predicted: DataFrame, golden: DataFrame) -> DataFrame:
    """(file_id, tp, fp, fn, id_map): greedy in predicted order, best free golden of the type.

    A file is one annotated chunk, so its two lists are short arrays of one row and the greedy pass
    is a fold over them. ``id_map`` is an array of struct(tmp_id, golden_id).
    """
    both = _side(predicted, "p").join(_side(golden, "g"), "file_id", "full_outer")
    none = F.slice("p", 1, 0)
    both = both.select("file_id", F.coalesce("p", F.slice("g", 1, 0)).alias("p"), F.coalesce("g", none).alias("g"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<tmp_id:string,golden_id:string>>").alias("map"))

    def best(acc: Column, p: Column) -> Column:
        scored = F.transform(
            "g",
            lambda g, i: F.when(
                (g["type"] == p["type"]) & ~F.array_contains(acc["used"], i),
                F.struct(_similarity(p, g).alias("score"), (-i).alias("neg"), g["tmp_id"].alias("golden_id")),
            ),
        )
        return F.array_max(F.filter(scored, lambda s: s["score"] >= NAME_MATCH))

    def step(acc: Column, p: Column) -> Column:
        return let(
            best(acc, p),
            lambda b: F.when(b.isNull(), acc).otherwise(
                F.struct(
                    F.concat(acc["used"], F.array(-b["neg"])).alias("used"),
                    F.concat(acc["map"], F.array(F.struct(p["tmp_id"].alias("tmp_id"), b["golden_id"].alias("golden_id")))).alias("map"),
                )
            ),
        )

    folded = both.select("file_id", F.size("p").alias("np"), F.size("g").alias("ng"), F.aggregate("p", start, step)["map"].alias("id_map"))
    tp = F.size("id_map")
    return folded.select(
        "file_id", tp.cast("long").alias("tp"), (F.col("np") - tp).cast("long").alias("fp"), (F.col("ng") - tp).cast("long").alias("fn"), "id_map"
    )


def relation_matches(predicted: DataFrame, golden: DataFrame, id_map: DataFrame | None = None) -> DataFrame:
    """(file_id, tp, fp, fn) of relation triples; each golden triple counts once.

    ``id_map(file_id, tmp_id, golden_id)`` renames predicted ends. Repeated predictions are wrong.
    """
    if id_map is not None:
        for end in ("source", "target"):
            names = id_map.select("file_id", F.col("tmp_id").alias(end), F.col("golden_id").alias("_g"))
            predicted = predicted.join(names, ["file_id", end], "left").withColumn(end, F.coalesce("_g", end)).drop("_g")
    key = ["file_id", "source", "target", "type"]
    return triple_matches(predicted.select(*key, F.lit(1).alias("p"), F.lit(0).alias("g")).unionAll(golden.select(*key, F.lit(0), F.lit(1))))


def triple_matches(triples: DataFrame) -> DataFrame:
    """(file_id, tp, fp, fn) of ``triples(file_id, source, target, type, p, g)``: predictions and golden ones a row stands for.

    One aggregation per triple; counts per file combine map-side.
    """
    per = triples.groupBy("file_id", "source", "target", "type").agg(F.sum("p").alias("p"), F.max("g").alias("g"))
    hit = (F.col("p") > 0) & (F.col("g") > 0)
    return per.groupBy("file_id").agg(F.count_if(hit).alias("tp"), (F.sum("p") - F.count_if(hit)).alias("fp"), (F.sum("g") - F.count_if(hit)).alias("fn"))


def prf(counts: DataFrame) -> DataFrame:
    """+ precision, recall, f1 (0 where undefined)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p = zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    r = zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
    with_pr = counts.withColumn("precision", p).withColumn("recall", r)
    return with_pr.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def micro_totals(counts: DataFrame) -> DataFrame:
    return prf(counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


FLAGS = ("retrieval_ok", "factual_ok", "citation_ok")


def eval_summary(items: DataFrame) -> DataFrame:
    """One row: items, rated, mean rating, and per flag the true and the answered count."""
    aggs = [F.count(F.lit(1)).alias("items"), F.count("rating").alias("rated"), F.coalesce(F.avg("rating"), F.lit(0.0)).alias("mean_rating")]
    for flag in FLAGS:
        aggs += [F.count_if(F.col(flag)).alias(f"{flag}_true"), F.count(flag).alias(f"{flag}_n")]
    return items.agg(*aggs)


def eval_item_status(items: DataFrame) -> DataFrame:
    """Per item: marks of the three flags and whether its annotation is complete."""
    mark = lambda c: F.when(F.col(c), MARKS[True]).when(~F.col(c), MARKS[False]).otherwise(MARKS[None])
    done = F.col("rating").isNotNull() & (F.trim(F.coalesce("gold_answer", F.lit(""))) != "")
    return items.select("item_id", "rating", *[mark(f).alias(f"{f}_mark") for f in FLAGS], done.alias("done"))


def eval_template(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their answers and empty annotation fields; questions without an answer stay.

    ``answers(qset_id, answer, confidence, grounded)``.
    """
    j = questions.join(answers, "qset_id", "left")
    return j.select(
        "qset_id", F.col("text").alias("question"), F.coalesce("answer", F.lit("")).alias("system_answer"),
        F.coalesce("confidence", F.lit("нет данных")).alias("confidence"), F.coalesce("grounded", F.lit(False)).alias("grounded"),
        F.when(F.col("answer").isNull(), "no answer").alias("error"), F.lit("").alias("gold_answer"), F.lit(None).cast("long").alias("rating"),
        F.lit(RATING_SCALE).alias("rating_scale"), *[F.lit(None).cast("boolean").alias(f) for f in FLAGS], F.lit("").alias("notes"),
    )


def retrieval_hit_rate(expected: DataFrame, cited: DataFrame) -> DataFrame:
    """One row: questions, hits, rate; a hit has its expected document among the cited ones."""
    pairs = cited.select("qset_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    j = expected.select("qset_id", "doc_id").join(pairs, ["qset_id", "doc_id"], "left")
    per = j.groupBy("qset_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return per.agg(F.count(F.lit(1)).alias("questions"), F.sum("hit").alias("hits"), F.avg("hit").alias("rate"))
