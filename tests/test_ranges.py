"""Range predicates over the attributes of nodes, against a plain loop."""

import operator
import random

from evigraph.operators import graph as G

OPS = {"<=": operator.le, "<": operator.lt, ">=": operator.ge, ">": operator.gt, "=": operator.eq}


def test_ranges_equal_a_plain_loop(spark):
    rng = random.Random(3)
    nodes = []
    for i in range(400):
        attrs = {"t": 7.0 if rng.random() < 0.4 else float(rng.randint(0, 50)), "p": rng.random(), "hole": None}
        nodes.append((f"n{i}", {k: v for k, v in attrs.items() if rng.random() < 0.9}))
    predicates = []
    for s in range(300):
        for _ in range(rng.randint(1, 3)):
            key = rng.choice(["t", "p", "t", "p", "hole", "none"] if s % 10 == 0 else ["t", "p"])
            value = rng.choice([7.0, float(rng.randint(-5, 55))]) if key == "t" else rng.random()
            predicates.append((s, key, rng.choice([*OPS, "!="] if s % 7 == 0 else [*OPS][:4]), value))
    predicates += [(1000, "t", ">=", 7.0), (1000, "t", ">=", 7.0), (1001, "p", ">", -1.0)]
    want = set()
    for s in {p[0] for p in predicates}:
        for i, attrs in nodes:
            if all(op in OPS and attrs.get(k) is not None and OPS[op](attrs[k], v) for q, k, op, v in predicates if q == s):
                want.add((s, i))
    table = spark.createDataFrame(nodes, "id string, attrs_num map<string,double>")
    got = G.numeric_range_filter(table, spark.createDataFrame(predicates, "set_id int, key string, op string, value double")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_many_sets_make_few_rows(spark):
    """Ten thousand sets: each is driven by its narrow predicate, not by the wide one."""
    nodes = spark.range(5000).selectExpr("concat('n', id) AS id", "map('x', cast(id AS double), 'y', cast(id % 10 AS double)) AS attrs_num")
    sets = spark.range(10_000).selectExpr("id AS set_id", "inline(array(struct('y' AS key, '>=' AS op, 0D AS value), struct('x' AS key, '=' AS op, cast(id % 6000 AS double) AS value)))")
    got = G.numeric_range_filter(nodes, sets)
    assert got.count() == 5000 + 4000


def test_no_nodes_or_predicates(spark):
    nodes = spark.createDataFrame([("a", {"x": 1.0})], "id string, attrs_num map<string,double>")
    sets = spark.createDataFrame([(1, "x", ">", 0.0)], "set_id int, key string, op string, value double")
    assert G.numeric_range_filter(nodes.limit(0), sets).collect() == []
    assert G.numeric_range_filter(nodes, sets.limit(0)).collect() == []
