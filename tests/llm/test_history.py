from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta, timezone

import pytest

from skysieve.llm.history import BAND, READINGS, MessageHistory, repeated_messages

SCHEMA = "record_no bigint, collection_batch int, source_message_id string, event_pair string, creation_date string, tca string, pair_key string, " + ", ".join(f"{r} double" for r in READINGS)
BAD = {None, "", "-", "N/A", "UNKNOWN", "NONE"}


def make(seed: int, n: int = 140):
    r, rows = random.Random(seed), []
    start = datetime(2031, 3, 1, tzinfo=timezone.utc)
    for no in range(1, n + 1):
        batch = 1 + no * 4 // (n + 1)
        old = r.choice(rows) if rows and r.random() < 0.5 else None
        if old and r.random() < 0.8:
            row = dict(old)
            kind = r.choice(["same", "id", "noise", "late", "update"])
            if kind != "same":
                row["source_message_id"] = f"m{no}"
            if kind == "id":
                row |= {"source_message_id": " " + str(old["source_message_id"] or "").upper(), "miss_distance": 1.0}
            if kind == "noise":
                row |= {"miss_distance": None if r.random() < 0.2 or row["miss_distance"] is None else row["miss_distance"] * 1.0004, "event_pair": "|".join(reversed(str(row["event_pair"] or "x|unknown").split("|"))).lower(), "at": row["at"] + timedelta(seconds=r.choice([0, 40, -30]))}
            if kind == "late":
                row["at"] = row["at"] + timedelta(seconds=70)
            if kind == "update":
                row["relative_speed"] = 123.0 + no
        else:
            row = {"source_message_id": r.choice([f"m{no}", f"m{no}", None, "N/A", "unknown"]), "event_pair": r.choice(["A-1|900", "900|A 1", "B-2|unknown", "B-2|901", None]), "at": start + timedelta(seconds=r.randint(0, 300_000)), "miss_distance": r.choice([None, r.random() * 1000, float("nan")]), "relative_speed": r.random() * 9000}
            row["to"] = start + timedelta(days=5, seconds=r.randint(0, 3))
        row |= {"record_no": no, "collection_batch": batch}
        rows.append(row)
    return rows


def brute(rows):
    alias = {"A 1": "A-1"}
    parent = {x["record_no"]: x["record_no"] for x in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def key(x):
        i = (x["source_message_id"] or "").strip().upper()
        return None if i in BAD else i

    def pair(x):
        p = [alias.get(s.strip().upper(), s.strip().upper()) for s in (x["event_pair"] or "").split("|")]
        return tuple(sorted(p)) if len(p) == 2 and not set(p) & BAD else None

    def close(a, b):
        return a is None or b is None or a != a or b != b or abs(a - b) <= 1e-3 * max(abs(a), abs(b))

    def alike(a, b):
        return all(close(a.get(r), b.get(r)) for r in ("miss_distance", "relative_speed"))

    for a, b in itertools.combinations(rows, 2):
        same = key(a) is not None and key(a) == key(b)
        near = pair(a) is not None and pair(a) == pair(b) and abs((a["at"] - b["at"]).total_seconds()) <= 60 and abs((a["to"] - b["to"]).total_seconds()) <= 5
        if same or near and alike(a, b):
            x, y = sorted((find(a["record_no"]), find(b["record_no"])))
            parent[y] = x
    batch = {x["record_no"]: x["collection_batch"] for x in rows}
    return {(find(x), x) for x in batch if batch[x] > batch[find(x)]}


def frame(spark, rows):
    data = [(x["record_no"], x["collection_batch"], x["source_message_id"], x["event_pair"], x["at"].isoformat(), x["to"].isoformat(), "clash", *(x.get(r) for r in READINGS)) for x in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([("a 1", "A-1")], "alias_designator string, designator string")


@pytest.mark.parametrize(("seed", "deliveries"), [(1, 2), (2, None)])
def test_against_brute_force(spark, aliases, seed, deliveries):
    rows = make(seed)
    got = {tuple(r) for r in repeated_messages(frame(spark, rows), aliases, deliveries=deliveries).collect()}
    assert got == brute(rows) and got


def test_batch_by_batch_gives_the_same(spark, aliases, tmp_path):
    rows = make(3, 80)
    path = f"file://{tmp_path}/history"
    for b in range(1, 5):
        MessageHistory(spark, path, aliases).accept(frame(spark, [x for x in rows if x["collection_batch"] == b]))
    assert {tuple(r) for r in MessageHistory(spark, path, aliases).repeats().collect()} == brute(rows)


def test_empty_and_null(spark, aliases):
    assert repeated_messages(spark.createDataFrame([], SCHEMA), aliases).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, None, "no time", None, *([None] * len(READINGS)))], SCHEMA)
    assert repeated_messages(nothing, aliases).count() == 0


def test_hot_group_of_copies(spark, aliases):
    rows = spark.range(1, 6001).selectExpr(
        "id as record_no", "cast(1 + id / 3000 as int) as collection_batch", "concat('m', id) as source_message_id", "if(id % 3 = 0, 'A-1|900', concat('A-1|', 10000 + id)) as event_pair",
        "'2031-01-01T00:00:00Z' as creation_date", "'2031-01-02T00:00:00Z' as tca", *[f"cast(1 as double) as {r}" for r in READINGS],
    )
    assert repeated_messages(rows, aliases).count() == sum(1 for i in range(3, 6001, 3) if 1 + i // 3000 > 1)


def test_crowded_cell_of_noisy_copies_and_strangers(spark, aliases):
    r = random.Random(11)
    start = datetime(2031, 3, 1, tzinfo=timezone.utc)
    rows = []
    for no in range(1, 301):
        stranger = no % 10 == 0
        base = {"miss_distance": 500.0 + no if stranger else 100.0, "relative_speed": 7000.0}
        rows.append({k: v * (1 + r.uniform(-4e-4, 4e-4)) if k == "miss_distance" else v for k, v in base.items()} | {"record_no": no, "collection_batch": 1 + no // 200, "source_message_id": f"m{no}", "event_pair": "A-1|900", "at": start + timedelta(seconds=r.randint(0, 58)), "to": start + timedelta(days=1)})
    assert {tuple(x) for x in repeated_messages(frame(spark, rows), aliases).collect()} == brute(rows)


def test_nothing_is_linked_beyond_the_metric(spark, aliases):
    start, to = datetime(2031, 3, 1, tzinfo=timezone.utc), datetime(2031, 3, 6, tzinfo=timezone.utc)
    late = [(0, "A-1|900"), (60.05, "A-1|900"), (0, "A-1|901"), (60, "A-1|901")]
    rows = [{"at": start + timedelta(seconds=s), "to": to, "event_pair": p, "miss_distance": 5.0} for s, p in late]
    rows += [{"at": start, "to": to + timedelta(seconds=s), "event_pair": "A-1|902", "miss_distance": 5.0} for s in (0, 5.02)]
    rows += [{"at": start, "to": to, "event_pair": "A-1|903", "t_position_covariance_det": d} for d in (1e40, 5e45)]
    rows += [{"at": start, "to": to, "event_pair": "A-1|904", "miss_distance": d} for d in (1000.0, 1001.2)]
    rows += [{"at": start, "to": to, "event_pair": "A-1|905", "miss_distance": d} for d in (float("inf"), 1001.2)]
    rows = [x | {"record_no": i, "collection_batch": i, "source_message_id": f"m{i}"} for i, x in enumerate(rows, 1)]
    assert [tuple(x) for x in repeated_messages(frame(spark, rows), aliases).collect()] == [(3, 4)]


def test_one_pivot_row_per_content_and_bands_by_distance(spark, aliases, tmp_path):
    start = datetime(2031, 3, 1, tzinfo=timezone.utc)
    rows = [{"record_no": i, "collection_batch": 1 + i // 20, "source_message_id": f"m{i}", "event_pair": "A-1|900", "miss_distance": 5.0 + i % 7, "at": start + timedelta(days=i % 7), "to": start + timedelta(days=40 * (i % 7))} for i in range(60)]
    history = MessageHistory(spark, f"file://{tmp_path}/history", aliases)
    history.accept_batches(frame(spark, rows))
    pivots = history.read("pivots").collect()
    assert len(pivots) == 7 and len({r["band"] for r in pivots}) == 7 and all(r["band"] == r["d_a"] // BAND for r in pivots)
    assert {tuple(r) for r in history.repeats().collect()} == brute(rows)


def test_large_deliveries_join_by_shuffle_alike(spark, aliases, monkeypatch):
    rows = make(4, 90)
    monkeypatch.setattr("skysieve.llm.history.SENT_KEYS", 0)
    monkeypatch.setattr("skysieve.llm.history.MOST_BANDS", 0)
    assert {tuple(r) for r in repeated_messages(frame(spark, rows), aliases).collect()} == brute(rows)
