"""Nested catalogs, sweeps over grids and evaluation sets against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rulespan.operators import assembly, sweep, trees


def leaves_by_hand(catalog):
    out = []
    domains = catalog.get("domains")
    for d in [x for x in domains if isinstance(x, dict)] if isinstance(domains, list) else []:
        for t in [x for x in d.get("topics") or [] if isinstance(x, dict)]:
            own = [r for r in t.get("rules") or [] if isinstance(r, dict)]
            if not own:

                def walk(node, own=own):
                    if isinstance(node, dict):
                        if isinstance(node.get("rule"), dict):
                            own.append(node["rule"])
                        for child in node.get("children") or []:
                            walk(child)

                walk(t.get("rule_tree") or {})
            out += [(d.get("name", "Unknown"), t.get("name", "Unknown"), i, r) for i, r in enumerate(own)]
    return out


def random_tree(rng, depth):
    node = {"children": [random_tree(rng, depth - 1) if rng.random() < 0.8 else rng.choice([None, 3, "x", []]) for _ in range(rng.randrange(4))]} if depth else {}
    if rng.random() < 0.7:
        node["rule"] = {rng.choice(["rule_id", "id"]): f" r{rng.randrange(30)} ", "trigger": rng.choice(["", "t"]), "check_logic": "c", "description": rng.choice(["", "own"])}
    return node


def test_leaves_of_trees_of_mixed_depth(spark):
    rng = random.Random(6)
    catalogs = []
    for _ in range(12):
        topics = [{"name": f"T{k}", "rule_tree": random_tree(rng, rng.randrange(6))} for k in range(3)]
        topics += [{"name": "flat", "rules": [{"rule_id": "f1"}, 4, {"id": "f2"}], "rule_tree": random_tree(rng, 2)}, {"rules": [], "rule_tree": random_tree(rng, 3)}, {"name": "none"}, "no topic"]
        catalogs.append({"domains": [{"name": "D", "topics": topics}, {"topics": topics[:1]}, None]})
    deep = {"rule": {"rule_id": "leaf"}}
    for _ in range(25):
        deep = {"children": [deep]}
    catalogs += [{"domains": [{"name": "D", "topics": [{"name": "deep", "rule_tree": deep}]}]}, {}, {"domains": 3}]
    rows = [(i, json.dumps(c)) for i, c in enumerate(catalogs)] + [(90, "{"), (91, None), (92, "[1]")]
    got = trees.rule_leaves(spark.createDataFrame(rows, "catalog int, json string")).collect()
    want = [(i, *leaf) for i, c in enumerate(catalogs) for leaf in leaves_by_hand(c)]
    order = sorted(got, key=lambda r: (r["catalog"], r["domain_no"], r["topic_no"], r["ordinal"]))
    assert [(r["catalog"], r["domain"], r["topic"], r["ordinal"], json.loads(r["rule"])) for r in order] == want
    for r in got:
        rule = json.loads(r["rule"])
        assert r["rule_id"] == (rule.get("rule_id") or rule.get("id") or "").strip()
        assert r["description"] == (rule.get("description") or "\n".join(f"{a}: {rule[b]}" for a, b in (("Trigger", "trigger"), ("Check Logic", "check_logic")) if rule.get(b)))
    leaves = spark.createDataFrame(got, trees.rule_leaves(spark.createDataFrame([], "catalog int, json string")).schema)
    found = {(r["catalog"], r["rule_id"]): json.loads(r["rule"]) for r in trees.find_rules(leaves, spark.createDataFrame([("r1",), ("f2",), ("absent",)], "rule_id string")).collect()}
    first = {}
    for r in order:
        first.setdefault((r["catalog"], r["rule_id"]), json.loads(r["rule"]))
    assert found == {k: v for k, v in first.items() if k[1] in ("r1", "f2")}


SCORED = "id int, topic_rank int, score double, margin double, generic_only boolean"


def test_sweep_as_exploded(spark):
    rng = random.Random(2)
    margins = {i: rng.choice([0.0, 0.5, 1.0]) for i in range(40)}
    rows = [(i, rng.randrange(1, 4), rng.choice([None, 0.0, 1.5, 4.0, 6.0, 7.25]), margins[i], rng.choice([True, False, None])) for i in margins for _ in range(rng.randrange(1, 5))]
    thresholds, penalties = [6.0, 4.0, 1.0, 99.0], [0.0, 1.25]
    got = sweep.sweep(spark.createDataFrame(rows, SCORED), thresholds, penalties).orderBy("place").collect()
    want = []
    for t in thresholds:
        for p in penalties:
            ok = [r for r in rows if r[2] is not None and r[2] - (p if r[1] > 1 else 0) >= t]
            ids = lambda c, ok=ok: len({r[0] for r in ok if c(r)})
            n = ids(lambda r: True), ids(lambda r: r[1] > 1), ids(lambda r: r[1] > 1 and r[3] <= 0.5), ids(lambda r: r[4])
            total = len({r[0] for r in rows})
            want.append((t, p, len(ok), *n, round(n[1] / total + 0.5 * n[2] / total + 0.25 * n[3] / total, 9)))
    best = sorted(want, key=lambda w: w[-1])
    assert [tuple(r)[:7] + (pytest.approx(r["objective"]),) for r in got] == best
    assert [r["place"] for r in got] == list(range(1, 9))


def test_sweep_of_nothing(spark):
    got = sweep.sweep(spark.createDataFrame([], SCORED), [1.0], [0.0, 1.0]).collect()
    assert [(r["n_published"], r["n_samples"], r["objective"]) for r in got] == [(0, 0, None)] * 2


def test_settings_merge(spark):
    rows = [({"a": 1.0, "b": 2.0}, {"b": 3.0, "c": 4.0}), (None, {"a": 1.0}), ({"a": 1.0}, None)]
    df = spark.createDataFrame(rows, "x map<string,double>, y map<string,double>")
    assert [r[0] for r in df.select(sweep.merged(F.col("x"), F.col("y"))).collect()] == [{"a": 1.0, "b": 3.0, "c": 4.0}, {"a": 1.0}, {"a": 1.0}]


def pools(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, rng.choice(["strict", "strict", "relaxed", "wrong"]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, pool string, stratum string")


def test_sets_have_their_sizes(spark):
    rows, df = pools(spark)
    n = {p: sum(r[1] == p for r in rows) for p in ("strict", "relaxed", "wrong")}
    sets = [("recall", 120, ["wrong"]), ("precision", n["relaxed"] + 60, ["relaxed", "strict"]), ("smoke", 50, ["strict", "wrong"]), ("none", 0, ["strict"])]
    got = assembly.assemble(df, sets, seed=3).collect()
    by = {s: [r for r in got if r["set"] == s] for s, _, _ in sets}
    assert {s: len(v) for s, v in by.items()} == {s: k for s, k, _ in sets}
    assert len({r["id"] for r in got}) == len(got) and {(r["id"], r["pool"], r["stratum"]) for r in got} <= set(rows)
    assert sum(r["pool"] == "strict" for r in by["precision"]) == 60
    wrong = [r for r in rows if r[1] == "wrong"]
    for s in ("a", "b", "c", None):  # in proportion, within one row
        assert abs(sum(r["stratum"] == s for r in by["recall"]) - 120 * sum(r[2] == s for r in wrong) / len(wrong)) < 1
    again = assembly.assemble(df.repartition(7), sets, seed=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got)) and sorted(map(str, assembly.assemble(df, sets, seed=4).collect())) != sorted(map(str, got))


def test_whole_pools_and_infeasible_sets(spark):
    rows, df = pools(spark, 90)
    every = [("all", 90, ["wrong", "strict", "relaxed"])]
    assert {r["id"] for r in assembly.assemble(df, every).collect()} == set(range(90))
    with pytest.raises(ValueError, match="needs 91"):
        assembly.assemble(df, [("all", 91, ["wrong", "strict", "relaxed"])])
    with pytest.raises(ValueError, match="late"):
        assembly.assemble(df, [*every, ("late", 1, ["wrong"])])
    with pytest.raises(ValueError, match="twice"):
        assembly.assemble(df, [("x", 1, ["wrong", "wrong"])])
    assert assembly.assemble(df.limit(0), [("none", 0, ["wrong"])]).isEmpty()


def test_splits_by_index(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("global_index"), F.concat(F.lit("t"), "id").alias("text"))
    wanted = spark.createDataFrame([("a", 3), ("a", 99), ("b", 7), ("b", 7)], "split string, global_index long")
    got = assembly.collect_splits(rows, wanted)
    assert sorted((r["split"], r["text"]) for r in got.collect()) == [("a", "t3"), ("a", "t99"), ("b", "t7")]
    assembly.export_splits(got, str(tmp_path / "out"), files=2)
    assert {(r["split"], r["text"]) for r in spark.read.json(str(tmp_path / "out")).collect()} == {("a", "t3"), ("a", "t99"), ("b", "t7")}
    for bad, match in ((("b", 3), "3 stands"), (("b", 100), "index 100")):
        with pytest.raises(ValueError, match=match):
            assembly.collect_splits(rows, wanted.union(spark.createDataFrame([bad], wanted.schema)))
