"""Persistent events by stretches give what the rule gives message by message."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta, timezone

import pytest

from skysieve.operators.sessions import persistent_events, stretches

START = datetime(2031, 1, 1, tzinfo=timezone.utc)
MESSAGES, KNOWN = "event_pair string, message_id bigint, tca timestamp, order_no bigint", "event_id string, event_pair string, tca_min timestamp, tca_max timestamp"
at = lambda s: START + timedelta(seconds=s)


def by_rule(messages, known, tolerance):
    out, events = set(), {}
    for e, pair, low, high in known:
        events.setdefault(pair, []).append([e, low, high])
    for pair, message, tca, _ in sorted(messages, key=lambda m: (m[3], str(m[1]))):
        own = events.setdefault(pair, [])
        near = [e for e in own if min(abs((tca - e[1]).total_seconds()), abs((tca - e[2]).total_seconds())) <= tolerance]
        if not near:
            near = [["ext-" + hashlib.sha256(f"{pair}|{message}".encode()).hexdigest()[:24], tca, tca]]
            own += near
        if len(near) == 1:
            near[0][1:] = min(near[0][1], tca), max(near[0][2], tca)
        out.add((str(message), near[0][0] if len(near) == 1 else None, len(near) > 1))
    return out


@pytest.mark.parametrize(("seed", "span"), [(1, 20_000), (2, 60_000), (3, 400_000)])
def test_stretches_change_nothing(spark, seed, span):
    r = random.Random(seed)
    messages = [(r.choice(["hot", "hot", "p", "q"]), i, at(r.randrange(0, span, 100)), r.randrange(200)) for i in range(400)]
    known = [(f"k{i}", r.choice(["hot", "p", "z"]), at(low), at(low + r.choice([0, 900, 9_000]))) for i, low in enumerate(r.randrange(0, span) for _ in range(12))]
    got = persistent_events(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(known, KNOWN))
    expected = by_rule(messages, known, 1800.0)
    assert {tuple(x) for x in got.collect()} == expected and any(a for _, _, a in expected)


def test_a_pair_is_cut_only_at_gaps(spark):
    rows = [("p", 0.0, 0.0), ("p", 10.0, 10.0), ("p", 20.1, 90.0), ("p", 50.0, 50.0), ("p", 100.0, 100.0), ("p", 110.5, 110.5), ("q", 10.0, 10.0)]
    got = stretches(spark.createDataFrame(rows, "event_pair string, low_s double, high_s double"), 10.0)
    assert sorted((x["event_pair"], x["low_s"], x["stretch"]) for x in got.collect()) == [("p", 0.0, 0), ("p", 10.0, 0), ("p", 20.1, 1), ("p", 50.0, 1), ("p", 100.0, 1), ("p", 110.5, 2), ("q", 10.0, 0)]
