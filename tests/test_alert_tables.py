"""A slice's table of the alert policy: right for every start, and few policies step through the rows."""

import random

import pytest

from rotorlake.functions.policy import ALERT, AlertPolicy
from rotorlake.operators import scan

POLICY = {"n": 3, "enter": 70.0, "leave": 30.0, "cooldown": 5.0}


def values(kind, n=2000):
    rng = random.Random(1)
    draw = {"mixed": lambda: rng.uniform(0, 100), "quiet": lambda: rng.uniform(0, 60), "hot": lambda: rng.uniform(70, 100)}[kind]
    return [(draw(), float(i // 2)) for i in range(n)]


@pytest.mark.parametrize("kind, most", [("mixed", 1.3), ("quiet", 2.3), ("hot", 4.6)])
def test_starts_that_meet_step_as_one(kind, most, monkeypatch):
    counts = {"made": 0, "steps": 0}

    class Counted(AlertPolicy):
        def __post_init__(self):
            counts["made"] += 1
            super().__post_init__()

        def step(self, p, t):
            counts["steps"] += 1
            return super().step(p, t)

    monkeypatch.setattr(scan, "AlertPolicy", Counted)
    fold, rows = scan.Alerts(**POLICY), values(kind)
    _, _, ends, table = fold.summary(rows)
    # hot: a streak stays what it was while the alert lasts, n + 1 of them
    assert counts["steps"] <= most * len(rows) and counts["made"] < 100
    for (state, streak, until), out in table.items():
        a, made = AlertPolicy(**POLICY, state=state, streak=streak, cooldown_until=until), None
        for p, t in rows:
            was = a.state
            a.step(p, t)
            made = a.cooldown_until if was == ALERT != a.state else made
        assert out == (a.state, min(a.streak, 3), made)
    # cooldowns that outlast the slice are only those of slices that end before
    assert len(table) == 8 * (len(ends) + 1)


def test_a_slice_shorter_than_its_cooldown():
    rows = [(80.0, 1.0 + i / 10) for i in range(12)]
    table = scan.Alerts(**POLICY).summary(rows)[3]
    for (state, streak, until), out in table.items():
        a = AlertPolicy(**POLICY, state=state, streak=streak, cooldown_until=until)
        for p, t in rows:
            a.step(p, t)
        assert out == (a.state, min(a.streak, 3), None)


def test_times_below_zero_wait_for_the_first_cooldown():
    rows = [(80.0, float(t)) for t in range(-40, 20)]
    fold, a = scan.Alerts(**POLICY), AlertPolicy(**POLICY)
    want, got, state = [a.step(p, t) for p, t in rows], [], fold.start()
    for lo in range(0, 60, 12):
        got += [x for x, in fold.run(state, rows[lo : lo + 12])]
        state = fold.after(state, fold.summary(rows[lo : lo + 12]))
    assert got == want and want.count(ALERT) == 20
    long = fold.after(fold.start(), fold.summary(rows))
    assert long[0] == ALERT
