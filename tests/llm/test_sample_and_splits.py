from __future__ import annotations

import random

import pytest

from skysieve.llm.forest import spanning_forest
from skysieve.llm.sample import PermanentNumbers, stable_sample
from skysieve.llm.splits import RelatedEvents, assign_parts, related_groups, split_records

RECORDS = "record_no bigint, collection_batch int, event_id string, study_cohort string, source_message_id string, event_pair string, uniform_value double"


def hexes(n):
    return f"{n:024x}"


@pytest.fixture(scope="module")
def collection(spark):
    r = random.Random(5)
    rows = []
    for i in range(1, 1201):
        e = hexes(r.randint(1, 400))
        rows.append((i, 1 + i // 300, r.choice([f"ext-{e}", f" EXT_{e.upper()}", e, f"ext-{e}\t"]), r.choice(["calibration", "EVALU", None, "__MISSING__", "evaluation "]), None, None, 0.5))
    rows.append((2000, None, None, "calibration", None, None, 0.1))
    return spark.createDataFrame(rows, RECORDS)


@pytest.fixture(scope="module")
def plan(spark):
    return spark.createDataFrame([("calibration", 50.0), ("evaluation", 30.0), (None, 20.0)], "study_cohort string, target_pct double")


def test_same_in_every_layout_and_spelling(spark, collection, plan):
    a = stable_sample(collection, plan).toPandas().sort_values("event_id").reset_index(drop=True)
    b = stable_sample(collection.repartition(7, "study_cohort"), plan).toPandas().sort_values("event_id").reset_index(drop=True)
    assert a.equals(b) and a["event_id"].is_unique and a["event_id"].str.match("ext-[0-9a-f]{24}$").all() and 60 < len(a) < 240


def test_chosen_events_stay_chosen(spark, collection, plan, tmp_path):
    path, chosen = f"file://{tmp_path}/numbers", set()
    for b in range(1, 6):
        registry = PermanentNumbers(spark, path)
        registry.observe(collection.filter(f"collection_batch = {b}"))
        now = {r["event_id"] for r in registry.selected(plan).collect()}
        assert chosen <= now
        chosen = now
    lower = spark.createDataFrame([("calibration", 1.0)], "study_cohort string, target_pct double")
    assert {r["event_id"] for r in PermanentNumbers(spark, path).selected(lower).collect()} == chosen
    assert chosen == {r["event_id"] for r in stable_sample(collection.filter("collection_batch is not null"), plan).collect()}


def test_empty_collection(spark, plan):
    assert stable_sample(spark.createDataFrame([], RECORDS), plan).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_forest_against_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(1000, 1001 + i) for i in range(50)] + [(7, 7), (None, 3)]
    edges += edges[:20]
    forest, members = spanning_forest(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            parent[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in members.collect()}
    assert set(got) == set(parent)
    groups = {}
    for x in got:
        groups.setdefault(got[x], set()).add(find(x))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(x) for x in parent})
    links = [tuple(x) for x in forest.collect()]
    assert len(links) == len(parent) - len(groups)
    assert all(got[u] == got[v] for u, v in links)


def test_relations_and_nulls(spark):
    a, b, c, d, e = (f"ext-{hexes(i)}" for i in range(1, 6))
    rows = [
        (1, 1, a, None, "m1", "A-1|900", 0.0), (2, 1, b.upper(), None, "x", "900|a 1", 0.0), (3, 1, c, None, " M1", None, 0.0), (4, 1, d, None, "N/A", "A-1|unknown", 0.0), (5, 1, e, None, "n/a", "unknown|A-1", 0.0),
        (6, 1, None, None, "m1", "A-1|900", 0.0), (7, 1, None, None, None, None, 0.0), (8, 1, d, None, None, "A-1|900|1", 0.0), (1, 1, a, None, "m1", "A-1|900", 0.0),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    aliases = spark.createDataFrame([("A 1", "A-1"), (None, "z")], "alias_designator string, designator string")
    members, _ = related_groups(df, aliases)
    assert {(r["group_id"], r["event"]) for r in members.collect()} == {(a, a), (a, b), (a, c)}
    diagnostics = spark.createDataFrame([(1, b, 0), (2, None, 1), (3, "ext_" + hexes(99), 2)], "diag_no bigint, event_id string, fold int")
    plan = spark.createDataFrame([("train", 70.0), ("test", 30.0)], "split_part string, target_pct double")
    out = split_records(df, diagnostics, plan, aliases).collect()
    assert len(out) == len(rows) + 3
    parts = {}
    for r in out:
        parts.setdefault(r["group_id"], set()).add(r["split_part"])
    assert all(len(p) == 1 for p in parts.values())
    group = {(r["table_name"], r["row_no"]): r["group_id"] for r in out}
    assert group[("external_collection", 6)] == group[("external_collection", 1)] == group[("history_gate_diagnostics", 1)]
    empty = spark.createDataFrame([], RECORDS)
    assert related_groups(empty, aliases)[0].count() == 0


def test_shares_with_giants(spark):
    groups = spark.range(20000).selectExpr("cast(id as string) as group_id", "cast(if(id = 0, 20000, 1 + id % 9) as bigint) as n_rows")
    plan = spark.createDataFrame([("train", 70.0), ("validation", 15.0), ("test", 15.0)], "split_part string, target_pct double")
    out = assign_parts(groups, plan).join(groups, "group_id").groupBy("split_part").agg({"n_rows": "sum"}).collect()
    total = sum(r[1] for r in out)
    assert assign_parts(groups, plan.limit(0)).filter("split_part is null").count() == 20000
    assert {r[0]: round(100 * r[1] / total) for r in out} == {"train": 70, "validation": 15, "test": 15}


@pytest.mark.parametrize("seed", range(3))
def test_shares_with_few_uneven_groups(spark, seed):
    r = random.Random(seed)
    sizes = [(f"g{i}", int(1 + r.paretovariate(0.9)) if i else 700) for i in range(250)]
    sizes = [(g, min(n, 700)) for g, n in sizes]
    plan = spark.createDataFrame([("train", 70.0), ("validation", 15.0), ("test", 15.0)], "split_part string, target_pct double")
    out = assign_parts(spark.createDataFrame(sizes, "group_id string, n_rows bigint"), plan).collect()
    total, rows = sum(n for _, n in sizes), dict(sizes)
    for part, pct in (("train", 70), ("validation", 15), ("test", 15)):
        assert abs(100 * sum(rows[x["group_id"]] for x in out if x["split_part"] == part) / total - pct) < 1


def test_words_without_digits_name_no_object(spark):
    a, b = (f"ext-{hexes(i)}" for i in (1, 2))
    rows = [(1, 1, a, None, None, "A-1|UNCATALOGUED", 0.0), (2, 1, b, None, None, "A-1|uncatalogued", 0.0), (3, 1, a, None, None, "A-1|to be named", 0.0), (4, 1, b, None, None, "A-1|TO BE NAMED", 0.0)]
    assert related_groups(spark.createDataFrame(rows, RECORDS))[0].count() == 0


def test_groups_grow_with_deliveries(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, 1 + i // 40, f"ext-{hexes(r.randint(1, 60))}", None, r.choice([None, f"m{r.randint(1, 70)}"]), r.choice([None, f"A-{r.randint(1, 9)}|{900 + r.randint(1, 9)}"]), 0.0) for i in range(120)]
    df = spark.createDataFrame(rows, RECORDS)
    grown = RelatedEvents(spark, f"file://{tmp_path}/related")
    for batch in (1, 2, 2, 3, 4):
        grown.accept(df.filter(f"collection_batch = {batch}"))
    pairs = lambda members: {(x["event"], x["group_id"]) for x in members.collect()}
    want = pairs(related_groups(df)[0])
    assert pairs(RelatedEvents(spark, f"file://{tmp_path}/related").groups()) == want and len(want) > 20
    assert RelatedEvents(spark, f"file://{tmp_path}/none").groups().count() == 0
