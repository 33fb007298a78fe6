"""Filter audit, periodic runs and the quality classifier against brute force, restatements and held-out labels."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import FMClassifier
from pyspark.sql import functions as F

from rulespan.llm import filter_audit, periodic_runs, quality_classifier, queries, shared

SPACES = " \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().split()


# --- filter audit ---


def audit_rows():
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(300)}" for _ in range(4000))
    texts = ["", None, "same", "same", "Same", "x" * 64, "x" * 64 + "y", "x" * 1024, "x" * 1024, "x" * 1025, "é" * 70, "é" * 70, "e" * 70, long, long, long[:-1] + "?", long + " A|B", "A B C", "a\xa0b c#", "🙂" * 40]
    texts += [" ".join(f"v{rng.randrange(k)}" for _ in range(n)) for k in (20, 900) for n in (150, 199, 200, 500)]
    texts += ["copy of many"] * 300 + [rng.choice(texts) for _ in range(80)]
    rows = [(i, t, rng.choice(["s0", "s0", "s1", None, ""]), 1) for i, t in enumerate(texts)]
    return [*rows, (None, "same", "s1", 1), (None, None, "s1", 1), rows[3], rows[14], (2, "x" * 64, "s2", 1)]


def own_mask(text):
    text, w = text or "", split(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * capitals > 2 * len(text)) + 8 * any(c in text for c in "#$%&*|")


def audit_by_hand(rows, labels):
    first, masks = {}, []
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, source, _ in rows:
        masks.append((i, source or "", own_mask(t) + 16 * (i is not None and i > first[t or ""])))
    out = {}
    good, toxic = ({i for i, *k in labels if i is not None and k[n] == 1} for n in (0, 1))
    for part in {s for _, s, _ in masks}:
        mine = [(i, m) for i, s, m in masks if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                removed = [k for k, (_, m) in enumerate(mine) if m & bit and k not in gone]
                redundant = sum(1 for k, (_, m) in enumerate(mine) if m & bit and k in gone)
                gone.update(removed)
                shapley[name] += len(removed)
                ids = [mine[k][0] for k in removed]
                out[part, "".join(order), step] = [len(mine) - len(gone), len(removed), redundant, sum(m == bit for _, m in mine), sum(i in good for i in ids), sum(i in toxic for i in ids)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


LABELS = [(i, i % 3 == 0, int(i % 5 == 0)) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (10**6, 1, 1)]


def audited(spark, rows, tables=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mask int").repartition(5)
    labels = spark.createDataFrame([(i, q if q is None else int(q), t) for i, q, t in LABELS], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, labels).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in found}, len(found)


def test_audit_by_hand(spark):
    got, n = audited(spark, audit_rows())
    assert n == len(got) and got == audit_by_hand(audit_rows(), LABELS)


def test_audit_rests_on_no_hash(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "block_hashes", lambda text: F.array(F.lit(7).cast("long")))
    monkeypatch.setattr(filter_audit, "GROUP", 3)
    rows = [(i, t, "s", 0) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb", "cc", "cc", "d", "dd", "ee", "aa"] * 3)]
    assert audited(spark, rows)[0] == audit_by_hand(rows, LABELS)


def test_audit_of_nothing(spark):
    assert audited(spark, []) == ({}, 0)
    rows = [(None, None, None, None)]
    assert audited(spark, rows)[0] == audit_by_hand(rows, LABELS)


@pytest.mark.parametrize("n", [0, 1, 64, 65, 1024, 1025, 16384, 16385, 300_000])
def test_blocks_cover_the_text(spark, n):
    base = "a" * n
    texts = [base] + [base[:k] + "b" + base[k + 1 :] for k in {0, 63, 64, 1023, 1024, 16383, n - 1} if 0 <= k < n]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(filter_audit.block_hashes(F.col("text")).alias("h"))
    assert len({tuple(r["h"]) for r in df.collect()}) == len(set(texts))


def test_audit_query(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.op11_filter_audit(spark, sf)
    want = c.sql(queries.ORACLES["op11_filter_audit"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


# --- periodic runs ---


def runs_by_hand(x, least=6, exponent=4):
    out = set()
    for p in range(1, len(x) // exponent + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                word = x[i : j + p]
                if not any(all(word[k] == word[k + q] for k in range(len(word) - q)) for q in range(1, p)):
                    out.add((i, j + p - i, p))
            i = j + 1
    return sorted(out)


def repetitive(rng):
    a = rng.choice([1, 2, 3, 6])
    x = [rng.randrange(a) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(4)):
        unit = [rng.randrange(a) for _ in range(rng.randrange(1, 7))]
        at, times = rng.randrange(len(x) + 1), rng.randrange(1, 9)
        x[at:at] = (unit * times)[: rng.randrange(1, len(unit) * times + 1)]
    return x


def test_runs_against_brute_force():
    rng = random.Random(11)
    for _ in range(4000):
        x = repetitive(rng)
        assert periodic_runs.find_runs(x) == runs_by_hand(x), x
        assert periodic_runs.find_runs(x, 9, 5) == runs_by_hand(x, 9, 5), x


@pytest.mark.parametrize("unit", [[0], [0, 1], [0, 0, 1], list(range(50_000)), [0, 1] * 9 + [2]])
def test_long_runs_end_in_time(unit):
    n = 200_000
    x = (unit * (n // len(unit) + 1))[:n]
    p = len(unit)
    inside = [r for r in periodic_runs.find_runs(x) if r[2] == p]
    assert inside == ([(0, n, p)] if n >= 4 * p else [])


def test_runs_of_odd_tables(spark):
    texts = [None, "", " \n\t ", "a " * 5, "a " * 6, "a b\n" * 4 + "c", "x\xa0y " * 8, "é ß " * 9, "w " * 30_000, "a b c d e f g"] + ["a b\n" * 4 + "c"] * 3
    df = spark.createDataFrame([(i, t, "k", i) for i, t in enumerate(texts)], "doc_id long, text string, runs string, `__own` long")
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = [x.decode() for x in split(t)]
        runs = runs_by_hand(w) if len(w) < 1000 else [(0, len(w), 1)]
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        assert [tuple(r) for r in got[i]["runs"]] == runs and got[i]["__own"] == i
        assert got[i]["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["densest"] is None) == (not runs)
    assert periodic_runs.periodic_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, min_exponent=3)


def test_runs_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r.asDict() for r in queries.op12_periodic_runs(spark, sf).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got.keys() == docs.keys() and any(r["n_runs"] for r in got.values())
    for i, text in docs.items():
        w, h = split(text), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = runs_by_hand(w) if n < 1500 else periodic_runs.find_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {k for s, m, p in runs for k in range(s + p, s + m)}
        assert got[i] == {
            "doc_id": i, "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), "collapsed_sha256": sha(b" ".join(x for k, x in enumerate(w) if k not in gone)),
        }


# --- quality classifier ---


def quality_rows():
    rng = random.Random(9)
    rows = []
    for i in range(400):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 60, 200]))]
        bad = i % 4 == 0
        if bad:
            w = [[x + "###" for x in w], [x.upper() + "!!" for x in w], [x for x in w[:20] for _ in range(9)], [x for y in w for x in (y, "|")]][i // 4 % 4]
        rows.append((i, " ".join(w) + ".", int(not bad), "k"))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.createDataFrame(quality_rows(), "doc_id long, text string, quality int, score string")
    return quality_classifier.fit(rows.where("doc_id % 5 > 0")), rows


def test_pair_sums_are_sums_over_pairs():
    rng = np.random.default_rng(2)
    factors = rng.normal(size=(30, 4))
    rows = [rng.choice(30, k, replace=False) for k in (1, 2, 7, 30)]
    values = [rng.normal(size=len(r)) for r in rows]
    got = quality_classifier.pair_sums(np.concatenate(rows), np.concatenate(values), np.cumsum([0] + [len(r) for r in rows[:-1]]), factors)
    want = [sum(factors[a] @ factors[b] * x[i] * x[j] for (i, a), (j, b) in itertools.combinations(enumerate(r), 2)) for r, x in zip(rows, values, strict=True)]
    assert np.allclose(got, want)


def test_scores_are_those_of_the_machine(spark):
    rows = spark.createDataFrame([(t, q) for _, t, q, _ in quality_rows()[:60]], "text string, label int").coalesce(1)
    zero, one = np.zeros(len(quality_classifier.STATISTICS)), np.full(len(quality_classifier.STATISTICS), 3.0)
    made = shared.cut(quality_classifier.vectors(rows, zero, one), "vectors")
    machine = FMClassifier(factorSize=3, maxIter=5, seed=1).fit(made)
    want = [r["probability"][1] for r in machine.transform(made).collect()]
    model = quality_classifier.QualityModel(zero, one, machine.intercept, machine.linear.toArray(), machine.factors.toArray())
    got = [r["score"] for r in model.score(rows).collect()]
    assert np.allclose(got, want)


def test_quality_held_out(fitted):
    model, rows = fitted
    held = model.score(rows.where("doc_id % 5 = 0")).collect()
    assert len(held) == 80 and sum(r["predicted"] == r["quality"] for r in held) >= 78
    assert all(r["predicted"] for r in held if r["quality"])


def test_quality_of_odd_tables(spark, fitted):
    model, _ = fitted
    texts = [None, "", " \n ", "é", "\x00", "a " * 200_000, "same text here", "same text here"]
    df = spark.createDataFrame([(i, t, "k", 2) for i, t in enumerate(texts)], "doc_id long, text string, predicted string, label int")
    got = model.score(df).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(8)) and all(0 <= r["score"] <= 1 and r["label"] == 2 for r in got)
    assert got[0]["score"] == got[1]["score"] and got[6]["score"] == got[7]["score"]
    assert model.score(df.where("false")).count() == 0


@pytest.mark.parametrize(("rows", "score"), [([], 0.0), ([("a", 1), ("b", 1), ("c", None)], 1.0), ([("a", 0), (None, 0)], 0.0)])
def test_quality_of_one_label(spark, rows, score):
    model = quality_classifier.fit(spark.createDataFrame(rows, "text string, quality int"))
    assert {r["score"] for r in model.score(spark.createDataFrame([("x",), (None,)], "text string")).collect()} == {score}


def test_quality_encoding():
    places, values, stats = quality_classifier.encoded("The the THE end!! 12 | é".encode())
    assert len(stats) == len(quality_classifier.STATISTICS) and (np.diff(places) > 0).all()
    for block in (places < quality_classifier.WORDS, places >= quality_classifier.WORDS):
        assert np.isclose((values[block] ** 2).sum(), 1)
    p, x, starts = quality_classifier.sparse(pa.array([b"a b", None], pa.binary()), np.zeros(len(stats)), np.ones(len(stats)))
    assert len(p) == len(x) and list(starts)[0] == 0 and p[starts[1] :].tolist() == list(range(quality_classifier.SIZE - len(stats), quality_classifier.SIZE))
