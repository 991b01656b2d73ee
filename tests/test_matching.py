"""New items against the sequential rule: directed keys, empty keys, families of like names."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from purchaseflow.operators import match
from purchaseflow.sources import files


@pytest.fixture
def cut(spark):
    def run(df):
        path = files.work_folder(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return run


def ratio(a, b):
    return 100.0 * (1 - match.indel(a, b) / (len(a) + len(b)))


def sequential(batch, master, least=90.0):
    """Of (id, key, stored) in order of id, the ids that are new."""
    known, new = [k for _, k in master if k], []
    for i, key, stored in sorted(batch):
        if not key or not any(s and ratio(key, s) >= least - 1e-7 for s in known):
            new.append(i)
            known.append(stored)
    return new


def squeeze(name):
    return re.sub(r"[\s\W]", "", name.lower())


def named(i, name):
    return i, squeeze(re.sub(r"\s*\([^)]*\)\s*$", "", name)), squeeze(name)


def kept(spark, batch, master, cut):
    b = spark.createDataFrame(batch, "id long, key string, stored string").repartition(3)
    return sorted(r.id for r in match.new_items(b, spark.createDataFrame(master, "id long, key string"), cut).collect() if r.kept)


def test_empty_keys_are_always_new(spark, cut):
    batch = [(1, "", ""), (2, "", ""), (3, "(x)", "x"), (4, "", "steelpipe"), (5, "steelpipe", "steelpipe"), (6, None, None)]
    assert kept(spark, batch, [(1, ""), (2, "other")], cut) == [1, 2, 3, 4, 6]


def test_names_ask_without_their_remark_and_are_stored_with_it(spark, cut):
    names = ["Seamless Pipe (SCH40 4inch)", "Seamless Pipe (SCH80 4inch)", "Seamless Pipe", "seamless pipes", "Gasket (a)", "Gasket (b)", "Gasket a", "Bolt", "BOLT (M8)"]
    batch = [named(k, x) for k, x in enumerate(names)]
    got = kept(spark, batch, [(1, "valve")], cut)
    assert got == sequential(batch, [(1, "valve")]) and 1 in got and 3 not in got


@pytest.mark.parametrize("portion", [7, 1000])
def test_new_items_follow_the_sequential_rule(spark, cut, monkeypatch, portion):
    monkeypatch.setattr(match, "PORTION", portion)
    rng = random.Random(9)
    roots = ["hydraulic pump unit", "hex bolt galvanised", "bearing housing left", "v belt", "o ring", ""]
    names = []
    for _ in range(90):
        name = list(rng.choice(roots))
        for _ in range(rng.randrange(4)):
            if name:
                name[rng.randrange(len(name))] = rng.choice("abcxyz0123")
        names.append("".join(name) + rng.choice(["", "", " (blue)", " (XL 12)"]))
    ids = rng.sample(range(1000), len(names))
    batch = [named(i, x) for i, x in zip(ids, names)]
    master = [(k, squeeze(x)) for k, x in enumerate(["hex bolt galvanized", "o rings", ""])]
    assert kept(spark, batch, master, cut) == sequential(batch, master)


def test_a_family_of_like_names_is_compared_with_few(spark, cut):
    rng = random.Random(2)
    batch = [(k, *["galvanisedpipeelbow" + "".join(rng.choices("0123456789", k=2))] * 2) for k in range(4000)]
    batch = [(k, key + str(k % 7), key + str(k % 7)) for k, key, _ in batch]
    began = time.time()
    got = kept(spark, batch, [], cut)
    assert time.time() - began < 120 and got == sequential(batch, [])


def test_best_match_keeps_one_row_for_each_key(spark):
    left = [(k, f"galvanisedpipe{k:03}x") for k in range(60)] + [(99, "nothinglikeit"), (100, ""), (101, None)]
    right = [(k, f"galvanisedpipe{k:03}") for k in range(300)]
    got = {r.id: (r.match_id, r.ratio) for r in match.best_match(spark.createDataFrame(left, "id long, key string"), spark.createDataFrame(right, "id long, key string")).collect()}
    for i, key in left:
        best = max(((ratio(key, k), -j) for j, k in right if key and ratio(key, k) >= 90), default=None)
        assert got[i] == ((-best[1], pytest.approx(best[0])) if best else (None, None))


def test_search_among_copies_looks_at_a_few_of_each_kind(spark):
    """Copies on both sides: only the first of those that no query tells apart are searched, and the results are brute force's."""
    names = ["red bolt", "new anvil", "hot ring m16*50", "red rod"]
    items = spark.createDataFrame([(k, names[k % 4], f"{k % 3}mm") for k in range(1000)], "item_id long, name string, spec string")
    queries = items.where("item_id % 50 = 0 OR item_id = 2").select(F.col("item_id").alias("query_id"), F.col("name").alias("text"))
    fields = {"name": 3, "spec": 2, "item_id": 1}
    two = lambda x: {x[i : i + 2] for i in range(len(x) - 1)}
    want = []
    for q in [2, *range(0, 1000, 50)]:
        g = two(names[q % 4])
        scores = sorted((1 - (3 * len(g & two(names[i % 4])) + 2 * len(g & two(f"{i % 3}mm")) + len(g & two(str(i)))) / (6 * len(g)), i) for i in range(1000))
        want += [(q, i, p, round(s, 9)) for p, (s, i) in enumerate([x for x in scores if x[0] <= 0.6][:5], 1)]
    got = match.search_top_k(queries, items, fields, 5, 0.6)
    assert sorted((r.query_id, r.item_id, r.place, round(r.score, 9)) for r in got.collect()) == sorted(want)
    asked = spark.createDataFrame([([g for n in names for g in two(n)],)], "g array<string>")
    kept = match._classes(items.select("item_id", F.col("name").alias("_0"), F.col("spec").alias("_1"), F.col("item_id").cast("string").alias("_2")), ["_0", "_1", "_2"], asked, 5)
    assert kept.groupBy("class_id").count().agg(F.max("count")).first()[0] == 5
    assert kept.count() <= 5 * 4 * 4  # names by which of 16 and 50 the id has; "mm" is in no query
