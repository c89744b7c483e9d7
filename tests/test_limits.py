"""Request limits against the rule written out, user by user."""

import random

import pytest
from conftest import rows

from gridwash.plans.limits import rate_limit, requests_in_window


def brute_force(requests, most, seconds):
    window, state, out = seconds * 1_000_000, {}, {}
    for user, at, request in sorted(requests, key=lambda r: (r[0], r[1], r[2])):
        kept = [t for t in state.get(user, []) if t > at - window]
        if len(kept) >= most:
            out[request] = (False, (kept[0] + window - at) / 1e6)
        else:
            kept.append(at)
            out[request] = (True, None)
        state[user] = kept
    return out


def traffic(seed, n=3000):
    """One user sends two thirds of all requests, in bursts and at equal times."""
    rng, clock, out = random.Random(seed), {}, []
    for i in range(n):
        user = 1 if rng.random() < 0.66 else rng.randrange(2, 12)
        clock[user] = clock.get(user, 0) + rng.choice([0, 1, 500_000, 3_000_000, 60_000_000 if rng.random() < 0.2 else 0])
        out.append((user, clock[user], i))
    return out


@pytest.mark.parametrize("seed,most,seconds", [(1, 3, 10), (2, 1, 5), (3, 30, 60), (4, 10, 60), (5, 2, 1)])
def test_rate_limit(spark, seed, most, seconds):
    data = traffic(seed)
    df = spark.createDataFrame(data, "user_id long, at long, request_id long").repartition(5)
    got = {r: (ok, wait) for r, ok, wait in rows(rate_limit(df, most, seconds), "request_id", "accepted", "retry_after")}
    assert got == brute_force(data, most, seconds)
    assert len({ok for ok, _ in got.values()}) == (1 if most == 30 and all(o for o, _ in got.values()) else 2)


def test_fourth_request_waits_and_users_are_independent(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(4)] + [("b", 3, 9)], "user_id string, at long, request_id long")
    got = {r: ok for r, ok in rows(rate_limit(df, 3, 60), "request_id", "accepted")}
    assert got == {0: True, 1: True, 2: True, 3: False, 9: True}


def test_requests_in_window(spark):
    data = traffic(7, 1200)
    df = spark.createDataFrame(data, "user_id long, at long, request_id long")
    got = dict(rows(requests_in_window(df, 10), "request_id", "requests_before"))
    for user, at, request in data:
        assert got[request] == sum(u == user and at - 10_000_000 < t < at for u, t, _ in data)
