"""Group totals that ride on the numbering: exact, and without a join that a hot group could not split."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusctx.operators import naming
from corpusctx.operators.ordering import number_rows


def plain_mapping(folders):
    out = []
    for project in {p for p, _, _ in folders}:
        own = [(n, m) for p, n, m in folders if p == project]
        numbered = [(int(x[1]), x[2], n) for n, _ in own if (x := re.fullmatch(r"(?s)([0-9]{1,18})-(.+)", n))]
        loose = sorted((m, n) for n, m in own if not re.fullmatch(r"(?s)([0-9]{1,18})-(.+)", n))
        largest = max([k for k, _, _ in numbered], default=0)
        width = 3 if largest + len(loose) >= 99 else 2
        out += [(project, n, k, f"{k:0{width}}-{base}") for k, base, n in numbered]
        out += [(project, n, largest + i, f"{largest + i:0{width}}-{n}") for i, (_, n) in enumerate(loose, 1)]
    return sorted(out, key=str)


def folders_of(seed, n=1500):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        project = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"p{rnd.randrange(40)}"
        name = f"{rnd.randrange(1, 400):03}-n{i}" if rnd.random() < 0.4 else f"n{i}"
        out.append((project, name, rnd.randrange(50)))
    return out + [("one", "7-x", 1), ("none", "loose", 3), ("hot", "n0-again", 1), ("hot", "n0-again", 1)]


@pytest.fixture
def unbroadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def join_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"SortMergeJoin(?:\(skew=true\))? \[(.*?)\], \[", plan), plan


def test_folder_mapping_of_a_hot_project(spark, unbroadcast):
    data = folders_of(1)
    df = spark.createDataFrame(data, "project string, name string, mtime long").withColumn("extra", F.lit(1)).repartition(6)
    mapped = naming.folder_mapping(df)
    keys, plan = join_keys(mapped)
    assert keys and all("_part" in k for k in keys) and "Broadcast" not in plan
    got = sorted((tuple(r) for r in mapped.select("project", "old_name", "number", "new_name").collect()), key=str)
    assert got == plain_mapping(data)
    assert naming.folder_mapping(df.limit(0)).count() == 0


def test_allocated_numbers_of_a_hot_project(spark, unbroadcast):
    rnd = random.Random(2)
    existing = [("hot", f"{k:03}-x") for k in (3, 250, 9)] + [("p1", "plain"), ("p2", "98-y"), ("gone", "5-z"), (None, "40-n")]
    new = [("hot" if i % 3 == 0 else rnd.choice(["p1", "p2", "p3", None]), i, f"v{i}") for i in range(600)]
    taken = spark.createDataFrame(existing, "project string, folder string")
    rows = spark.createDataFrame(new, "project string, at int, value string").repartition(5)
    numbered = naming.allocate_numbers(taken, rows, ["at"])
    keys, _ = join_keys(numbered)
    assert numbered.columns == ["project", "at", "value", "number", "label"] and keys and all("_part" in k for k in keys)
    largest, expected = {"hot": 250, "p2": 98, None: 40}, []
    for project in {p for p, _, _ in new}:
        for k, (_, at, value) in enumerate(sorted((x for x in new if x[0] == project), key=lambda x: x[1]), largest.get(project, 0) + 1):
            expected.append((project, at, value, k, f"{k:0{3 if k - 1 >= 99 else 2}}"))
    assert sorted((tuple(r) for r in numbered.collect()), key=str) == sorted(expected, key=str)
    assert naming.allocate_numbers(taken, rows.limit(0), ["at"]).count() == 0
    assert {r.number for r in naming.allocate_numbers(taken.limit(0), rows.where("project = 'p2'"), ["at"]).collect()} == set(
        range(1, 1 + sum(p == "p2" for p, _, _ in new))
    )


def test_totals_reach_every_part_of_a_group_evenly(spark, unbroadcast):
    """A third of the rows are one group: its rows lie in as many tasks as their share."""
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        df = spark.range(12_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("g"), "id")
        out = number_rows(df, ["g"], ["id"], totals={"n": (F.count("*"), F.sum), "top": (F.max("id"), F.max)})
        rows = {r.g: (r.n, r.top, r.last) for r in out.groupBy("g").agg(F.first("n").alias("n"), F.first("top").alias("top"), F.max("seq").alias("last")).collect()}
        assert rows["hot"] == (4000, 11_997, 4000) and all(n == last for n, _, last in rows.values())
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect())
        hot = out.where("g = 'hot'").groupBy(F.spark_partition_id().alias("p")).count()
        assert hot.count() >= 3 and sizes[-1] <= 4 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
