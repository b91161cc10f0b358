import difflib
import random

from pyspark.sql import functions as F

from evigraph import session
from evigraph.functions.skew import hot_key_hashes, previous_value, spread_join
from evigraph.operators import components as components_module
from evigraph.operators import curation as C
from evigraph.operators import evaluation as E
from evigraph.operators.components import components
from evigraph.operators.extraction import parse_extractions
from evigraph.operators.matching import similar_names, substring_join

from test_text import same_word


def similarity(new, old):
    a, b = [w for w in new.split() if len(w) > 2], [w for w in old.split() if len(w) > 2]
    if not a or not b:
        return float(new == old)
    return sum(any(same_word(x, y) for y in b) for x in a) / len(a)


def random_name(rng):
    stems = ["nickel", "nickels", "matte", "mattes", "slag", "ore", "ores", "oxide", "oxides", "coppery", "copper", "ab", "x"]
    return " ".join(rng.choice(stems) for _ in range(rng.randrange(1, 5)))


def test_resolution_equals_reading_in_order(spark):
    rng = random.Random(3)
    rows, expect = [], {}
    for run in range(40):
        nodes = []
        for pos in range(rng.randrange(1, 25)):
            name = random_name(rng)
            name = name.upper() if rng.random() < 0.3 else name
            low = name.lower()
            best, leader = 0.0, None
            for known in nodes:
                score = 2.0 if known == low else similarity(low, known)
                if score > best:
                    best, leader = score, known
            if best < 0.75:
                nodes.append(low)
                leader = low
            rows.append((f"t{run}", name, pos))
            expect[f"t{run}", pos] = leader
    df = spark.createDataFrame(rows, "type string, name string, pos long").repartition(8)
    got = {(r.type, r.pos): r.leader for r in C.resolve_batch(df).collect()}
    assert got == expect


def test_existing_nodes_lead(spark):
    new = spark.createDataFrame([("m", "nickel mattes", 5), ("m", "slag", 6)], "type string, name string, pos long")
    old = spark.createDataFrame([("m", "Nickel matte")], "type string, name string")
    assert {r.name: r.leader for r in C.resolve_batch(new, old).collect()} == {"nickel mattes": "nickel matte", "slag": "slag"}


def test_similar_names_loses_no_pair(spark):
    rng = random.Random(5)
    names = sorted({random_name(rng) for _ in range(150)})
    df = spark.createDataFrame([("m", n) for n in names], "type string, lname string")
    for threshold in (0.5, 0.75, 1.0):
        got = {(r.lname, r.old_lname) for r in similar_names(df, df, threshold).collect()}
        assert got == {(a, b) for a in names for b in names if a == b or similarity(a, b) >= threshold}


def test_substring_join_equals_brute_force(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé c") for _ in range(rng.randrange(0, 30))) for _ in range(80)]
    patterns = ["".join(rng.choice("abé c") for _ in range(rng.randrange(0, 6))) for _ in range(80)]
    t = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    p = spark.createDataFrame([(x,) for x in patterns], "p string")
    want = {(i, x) for i, s in enumerate(texts) for x in patterns if x and x in s}
    assert {tuple(r) for r in substring_join(t, p, "i", "t", "p").collect()} == want


def test_spread_join_is_exact_on_hot_keys(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    other = spark.range(40).select((F.col("id") % 20).alias("k"), F.col("id").alias("w"))
    assert len(hot_key_hashes(big, ["k"], 0.1).first().hot) == 1
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, big.join(other, "k", how).collect()), key=repr)
        spread = spread_join(big, other, ["k"], how, share=0.0, fanout=5).select(*big.join(other, "k", how).columns)
        assert sorted(map(tuple, spread.collect()), key=repr) == plain


def test_previous_value_across_buckets(spark):
    rng = random.Random(1)
    rows = [("k%d" % rng.randrange(3), pos, rng.randrange(4)) for pos in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    got = {(r.k, r.pos): r.prev for r in previous_value(df, ["k"], F.col("pos"), F.floor(F.col("pos") / 37), "v", "prev").collect()}
    last = {}
    for k, pos, v in sorted(rows, key=lambda r: r[1]):
        assert got[k, pos] == last.get(k)
        last[k] = v


def test_edge_upsert_merges_attributes(spark):
    df = spark.createDataFrame([("a", "b", "T", {"x": "1", "y": "1"}, 1), ("a", "b", "T", {"x": "2"}, 2), ("a", "c", "T", {}, 1)], "source string, target string, type string, attrs_str map<string,string>, seq int")
    assert sorted((r.target, r.key or "", r.value or "") for r in C.edge_upsert(df).collect()) == [("b", "x", "2"), ("b", "y", "1"), ("c", "", "")]


def test_extraction_drops_bad_rows_one_by_one(spark):
    raw = '```json\nok {"entities":[{"tmp_id":"e1","type":"material","name":"Ni","attrs":{"mass_kg":2,"note":"n"}},{"tmp_id":"e2","type":"nope","name":"x"},{"type":"material","name":"y"},7],"relations":[{"source":"pub","target":"e1","type":"TAGGED_AS"},{"source":"pub","type":"TAGGED_AS"}]}\n```'
    df = spark.createDataFrame([(1, 0, raw), (2, 0, "no json")], "doc_id long, chunk_no long, raw string")
    ents, rels = parse_extractions(df)
    e = ents.collect()
    assert [(r.tmp_id, r.attrs_num, r.attrs_str) for r in e] == [("e1", {"mass_kg": 2.0}, {"note": "n"})]
    assert [(r.source_tmp, r.target_tmp, r.type) for r in rels.collect()] == [("pub", "e1", "TAGGED_AS")]


def test_entity_match_is_greedy_in_order(spark):
    p = spark.createDataFrame([("f", 1, "p1", "m", "nickel matte"), ("f", 2, "p2", "m", "nickel"), ("f", 3, "p3", "x", "slag")], "file_id string, pos long, tmp_id string, type string, name string")
    g = spark.createDataFrame([("f", 1, "g1", "m", "nickel ore"), ("f", 2, "g2", "m", "nickel matte"), ("h", 1, "g3", "m", "z")], "file_id string, pos long, tmp_id string, type string, name string")
    got = {r.file_id: (r.tp, r.fp, r.fn, [(m.tmp_id, m.golden_id) for m in r.id_map]) for r in E.entity_matches(p, g).collect()}
    assert got == {"f": (2, 1, 0, [("p1", "g2"), ("p2", "g1")]), "h": (0, 0, 1, [])}


def sequential_leaders(names, links):
    """Names in order; a name leads unless an earlier leader is linked with it."""
    lead = set()
    for pos, name in sorted((pos, name) for name, pos in names.items()):
        if not any((names[o], o) < (pos, name) and o in lead for o in links.get(name, ())):
            lead.add(name)
    return lead


def leaders_of(spark, names, links, **args):
    n = spark.createDataFrame([("m", name, pos, False) for name, pos in names.items()], "type string, lname string, pos long, fixed boolean")
    p = spark.createDataFrame([("m", a, b) for a, old in links.items() for b in old], "type string, lname string, old_lname string")
    return {r.lname for r in C.leaders(n, p, **args).collect()}


def count_cuts(monkeypatch):
    done = []
    real = session.cut_to_table
    for module in (C, components_module):
        monkeypatch.setattr(module, "cut_to_table", lambda df: done.append(1) or real(df))
    return done


def test_leaders_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    names = {f"n{i:04d}": i for i in range(1000)}
    links = {f"n{i:04d}": [f"n{i - 1:04d}"] for i in range(1, 1000)}
    cuts = count_cuts(monkeypatch)
    assert leaders_of(spark, names, links) == {f"n{i:04d}" for i in range(0, 1000, 2)}
    assert len(cuts) < 40  # three tables a round of contraction


def test_leaders_equal_the_sequential_ones_also_over_cut_components(spark):
    rng = random.Random(21)
    names = {f"n{i}": pos for i, pos in enumerate(rng.sample(range(300), 120))}
    order = sorted(names, key=lambda n: names[n])
    links = {}
    for i, name in enumerate(order[1:], 1):
        # Mostly neighbours, so that chains run through all groups.
        links[name] = {order[max(0, i - rng.randrange(1, 4))] for _ in range(rng.randrange(1, 4))}
    want = sequential_leaders(names, links)
    assert leaders_of(spark, names, links) == want
    assert leaders_of(spark, names, links, plain_rounds=0, group_links=40) == want


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    rows = chain + star + [(2000, 2000), (3000, 3001), (3001, 3000)]
    got = {}
    for r in components(spark.createDataFrame(rows, "a long, b long")).collect():
        got.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(201)), list(range(1000, 1050)), [3000, 3001]]


def test_facts_keep_their_type(spark):
    rows = [
        ("e", "f1", 1, 1, {"mass_kg": 2.0}, {"grade": "high"}),
        ("e", "f2", 2, 2, {"mass_kg": 2.0, "grade": 1.0}, {}),
        ("e", "f3", 3, 3, {}, {"mass_kg": "2.0", "grade": "1.0"}),
        ("e", "f4", 4, 4, None, None),
    ]
    m = spark.createDataFrame(rows, "entity_id string, source_file string, doc_id long, pos long, attrs_num map<string,double>, attrs_str map<string,string>")
    facts = C.fact_rows(m)
    changes = {(r.attr, tuple(r.old_value), tuple(r.new_value), r.source_file) for r in C.fact_history(facts).collect()}
    assert changes == {
        ("grade", (None, "high"), (1.0, None), "f2"), ("grade", (1.0, None), (None, "1.0"), "f3"),
        ("mass_kg", (2.0, None), (None, "2.0"), "f3"),
    }
    assert {(r.attr, tuple(r.value)) for r in C.current_facts(facts).collect()} == {("grade", (None, "1.0")), ("mass_kg", (None, "2.0"))}
    assert C.fact_rows(m.drop("attrs_str")).count() == 3


def test_mention_history_equals_the_history_of_facts_and_shuffles_mentions(spark):
    rng = random.Random(4)
    rows = [
        (f"e{rng.randrange(3)}", f"f{i % 5}", i // 4, i, {"a_kg": float(rng.randrange(2)), "b": None}, {"c": rng.choice("xy")} if i % 3 else None)
        for i in range(400)
    ]
    m = spark.createDataFrame(rows, "entity_id string, source_file string, doc_id long, pos long, attrs_num map<string,double>, attrs_str map<string,string>")
    want, last = [], {}
    for entity, source, _, pos, num, text in rows:
        for attr, value in [(k, (v, None)) for k, v in num.items() if v is not None] + [(k, (None, v)) for k, v in (text or {}).items()]:
            old = last.get((entity, attr))
            if old is not None and old != value:
                want.append((entity, attr, old, value, source, pos))
            last[entity, attr] = value
    for history in (C.mention_history(m, 7), C.fact_history(C.fact_rows(m), 7)):
        got = [(r.entity_id, r.attr, tuple(r.old_value), tuple(r.new_value), r.source_file, r.pos) for r in history.collect()]
        assert sorted(got, key=lambda r: (r[5], r[1])) == sorted(want, key=lambda r: (r[5], r[1]))
    plan = C.mention_history(m, 7)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "lambda" not in plan and "hashpartitioning(entity_id" in plan


def test_ratio_is_exact_or_below_and_gives_up_early(monkeypatch):
    rng = random.Random(8)
    texts = ["", "a", "x" * 300] + ["".join(rng.choices("abcdefgh ", k=rng.randrange(1, 320))) for _ in range(40)]
    for a in texts:
        for b in texts[::3]:
            want, got = difflib.SequenceMatcher(None, a, b).ratio(), C.ratio_from(0.5, a, b)
            assert got == want if want >= 0.5 else got is None or got == want
    calls = []
    find = difflib.SequenceMatcher.find_longest_match
    monkeypatch.setattr(difflib.SequenceMatcher, "find_longest_match", lambda self, *at: calls.append(1) or find(self, *at))
    assert C.ratio_from(0.9, "abcdefgh" * 8, "hgfedcba" * 8) is None
    early, calls[:] = len(calls), []
    difflib.SequenceMatcher(None, "abcdefgh" * 8, "hgfedcba" * 8).ratio()
    assert 0 < early < len(calls) / 4
