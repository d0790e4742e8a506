"""Balancing inside folds, and baskets of several blocks."""

import itertools
import threading

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tallyforge.operators import imbalance, learners, recommend
from tallyforge.plans import automl, tuning


def rare(spark, n=160):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        label = float(i % 8 == 0)
        rows.append((i, label, [float(v) for v in rng.normal(size=3) + label]))
    return spark.createDataFrame(rows, "key long, label double, x array<double>").select("key", "label", array_to_vector("x").alias("features"))


def test_balancing_sees_no_row_of_its_validation_fold(spark):
    df = rare(spark)
    seen, lock = [], threading.Lock()
    smote = automl.balancer("smote")

    def watched(rows):
        keys = {r.key for r in rows.select("key").collect()}
        made = imbalance.smote(rows.withColumn("features", vector_to_array("features")))
        used = {k for r in made.select("source", "neighbour").collect() for k in (r.source, r.neighbour)}
        with lock:
            seen.append((keys, used))
        return smote(rows)

    make = lambda: learners.build("logistic", "classification", 160)
    out = tuning.cross_validate(make, df, "classification", "roc_auc", 4, resample=watched)
    assert len(out["values"]) == 4 and len(seen) == 4
    held = [set(range(160)) - keys for keys, _ in seen]
    assert sorted(itertools.chain(*held)) == list(range(160))  # each row is in one validation fold
    assert all(used <= keys and not used & outside for (keys, used), outside in zip(seen, held))


def test_balancers(spark):
    df = rare(spark)
    sizes = lambda rows: sorted(r["count"] for r in rows.groupBy("label").count().collect())
    assert sizes(automl.balancer("smote")(df)) == [140, 140]
    assert sizes(automl.balancer("undersample")(df)) == [20, 20]
    weights = {r.label: r.weight for r in automl.balancer("class_weight")(df).select("label", "weight").distinct().collect()}
    assert weights[1.0] / weights[0.0] == 7.0
    assert automl.balancer("none") is None
    single = df.filter("label = 0 or key = 0")
    assert automl.balancer("smote")(single).count() == single.count()


def test_long_baskets_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(recommend, "BASKET_BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(0, f"i{i:03}") for i in range(60)] + [(u, f"i{int(i):03}") for u in range(1, 30) for i in rng.choice(80, 6, replace=False)]
    df = spark.createDataFrame(rows, "u int, i string")
    basket = recommend.baskets(df, "u", "i")
    want = {}
    by_user = {}
    for u, i in set(rows):
        by_user.setdefault(u, set()).add(i)
    for items in by_user.values():
        for a, b in itertools.permutations(sorted(items), 2):
            want[a, b] = want.get((a, b), 0) + 1
    got = {(r.item, r.neighbour): r.support for r in recommend.cooccurrence(basket, 2).collect()}
    assert got == {k: v for k, v in want.items() if v >= 2}
    # the 45 meetings of the nine blocks of one user lie on keys of their own
    coded = basket.filter("user = '0'").withColumn("code", F.xxhash64("item"))
    met = recommend._met_blocks(coded)
    blocks = -(-60 // 7)
    assert met.select("i", "j").distinct().count() == met.count() <= blocks * (blocks + 1) // 2


def test_pairs_are_shuffled_as_lists_of_the_rarer_item(spark):
    """One row per basket and item, however many pairs there are, and few for an item everybody has."""
    rows = [(u, f"i{i:02}") for u in range(40) for i in {0, *((u * 7 + 5 * j) % 50 for j in range(12))}]
    basket = recommend.baskets(spark.createDataFrame(rows, "u int, i string"), "u", "i")
    items = basket.groupBy("item").count().orderBy("count", "item").collect()
    codes = spark.createDataFrame([(r.item, c) for c, r in enumerate(items)], "item string, code int")
    sent = recommend._partners(recommend._met(recommend._blocks(basket.join(codes, "item")))).collect()
    assert len(sent) <= basket.count() and not any(items[r.a].item == "i00" for r in sent)
    sizes = [r["count"] for r in basket.groupBy("user").count().collect()]
    assert sum(len(r.bs) for r in sent) == sum(n * (n - 1) // 2 for n in sizes)
