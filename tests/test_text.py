import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators.questions import detect_country, detect_year_cutoff, expand_synonyms, extract_numeric_filters

import datetime


def same_word(a, b):
    if a == b:
        return True
    shorter = min(len(a), len(b))
    need = max(3, 3 * shorter // 5)
    return shorter >= 4 and a[:need] == b[:need]


words = st.text(alphabet="аbcд", min_size=0, max_size=9)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=40, max_size=80))
def test_word_match_and_its_blocking_key(spark, pairs):
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    rows = df.select("a", "b", T.word_match(F.col("a"), F.col("b")).alias("m"), (T.match_key(F.col("a")) == T.match_key(F.col("b"))).alias("k")).collect()
    for r in rows:
        assert r.m == same_word(r.a, r.b)
        assert r.k or not r.m  # no match is lost by the key


def test_name_similarity_is_share_of_first_name(spark):
    df = spark.createDataFrame([("никелевая руда штейн", "никелевой руды"), ("никелевой руды", "никелевая руда штейн"), ("ab", " AB"), ("ab", "abc")], "a string, b string")
    got = [round(r[0], 4) for r in df.select(T.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [0.6667, 1.0, 1.0, 0.0]


def test_language_classes(spark):
    df = spark.createDataFrame([("",), ("123 %",), ("шлак и штейн",), ("matte and slag",), ("штейн matte",)], "t string")
    assert [r[0] for r in df.select(T.script_language(F.col("t"))).collect()] == ["unknown", "other", "ru", "en", "mixed"]


def test_snippets_locations_and_biblio(spark):
    df = spark.createDataFrame(
        [("[para 3]  · Метод  даёт [page 5] рост", "page 5, para 2, page 6, page 5, slide 3", "A Smith, B… Lee; C Roe - Journal of X, 2019 - Elsevier")], "s string, l string, b string"
    )
    r = df.select(T.clean_snippet(F.col("s")).alias("s"), T.clean_location(F.col("l")).alias("l"), T.parse_biblio_line(F.col("b")).alias("b")).first()
    assert r.s == "Метод даёт рост"
    assert r.l == "стр. 5, 6 · слайд 3"
    assert r.b.authors == ["A Smith", "C Roe"] and r.b.venue == "Journal of X" and r.b.year == 2019


def test_string_arrays_skip_other_items(spark):
    raw = ['```json\n["a b", 3, "c", null]\n```', "nothing", '["x"', 'say ["one","two"] ok']
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    assert [r[0] for r in df.select(T.parse_string_array(F.col("r"))).collect()] == [["a b", "c"], None, None, ["one", "two"]]


def test_numeric_filters(spark):
    cases = {
        "сульфаты 200-300 мг/л, сухой остаток ≤1000": {("sulfate_mg_l", ">=", 200.0), ("sulfate_mg_l", "<=", 300.0), ("dry_residue_mg_l", "<=", 1000.0)},
        "по сульфат и хлорид 200–300,5 мг/л": {("sulfate_mg_l", ">=", 200.0), ("sulfate_mg_l", "<=", 300.5), ("chloride_mg_l", ">=", 200.0), ("chloride_mg_l", "<=", 300.5)},
        "глубина не менее 2,5 и капзатраты 7": {("injection_depth_m", ">=", 2.5), ("capex_musd", "<=", 7.0)},
        "работа над глубиной": set(),
        "глубина выработки 12": {("injection_depth_m", "<=", 12.0)},
    }
    df = spark.createDataFrame([(q,) for q in cases], "t string")
    for r in df.select("t", extract_numeric_filters(F.col("t")).alias("f")).collect():
        assert {(p.key, p.op, p.value) for p in r.f} == cases[r.t], r.t


def test_country_years_synonyms(spark):
    df = spark.createDataFrame([("отечественная практика за последние 5 лет",), ("мировой опыт matte",), ("в РФ и за рубежом",)], "t string")
    got = df.select(
        detect_country(F.col("t")).alias("c"), detect_year_cutoff(F.col("t"), datetime.date(2026, 1, 1)).alias("y"), expand_synonyms(F.col("t")).alias("s")
    ).collect()
    assert [r.c for r in got] == ["RU", "INTL", None]
    assert [r.y for r in got] == ["2021-01-02", None, None]
    assert got[1].s == "мировой опыт matte штейн" and got[0].s == "отечественная практика за последние 5 лет"


def test_tokens(spark):
    df = spark.createDataFrame([("Что делали с Ni-рудой в 2020 году, а?",)], "t string")
    assert df.select(T.tokenize(F.col("t"))).first()[0] == ["Ni-рудой", "2020", "году"]
    assert re.fullmatch(r"material_[0-9a-f]{16}", df.select(T.stable_id(F.lit("material"), F.lit(" Ni "))).first()[0])


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_script_language_computes_its_text_once(spark):
    df = spark.createDataFrame([("ab cd",), ("абвгд a",), ("аб ab",), ("1 2",), ("  ",), ("ßж é",), (None,)], "t string")
    got = [r[0] for r in df.select(T.script_language(F.col("t"))).collect()]
    assert got == ["en", "ru", "mixed", "other", "unknown", "ru", "other"]
    plan = optimized(spark.range(5).select(T.script_language(F.translate(F.col("id").cast("string"), "1", "x")).alias("lang")))
    assert plan.count("translate(") == 1


def test_numeric_filters_are_cut_out_by_all_cores(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.queries()["extract_numeric_filters"](spark, sf_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_extracted_elements_are_parsed_once(spark):
    from evigraph.operators.extraction import parse_extractions

    raw = spark.createDataFrame([(1, 0, 'x {"entities": [{"tmp_id": "e1", "type": "material", "name": "n", "attrs": {"m": 2, "t": "a", "z": null}}, {"type": "material"}, 5], "relations": []} y'), (2, 0, None), (3, 0, "none")], "doc_id long, chunk_no long, raw string")
    ents, rels = parse_extractions(raw)
    assert [tuple(r) for r in ents.collect()] == [(1, 0, 0, "e1", "material", "n", {"m": 2.0}, {"t": "a"})] and rels.collect() == []
    named = optimized(spark.range(3).selectExpr("id AS doc_id", "id AS chunk_no", "cast(id AS string) AS raw").transform(lambda d: parse_extractions(d)[0].select("tmp_id", "type", "name")))
    assert named.count("from_json(") == 2
