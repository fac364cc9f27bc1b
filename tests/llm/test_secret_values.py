"""Secrets that are short, hold other characters, or are joined by dots."""

from rotorlake.llm import secrets_scan

JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmNHl0w5N_XgL0"
TEXTS = [('password = "hunter2xyz9" here', "hunter2xyz9"), ("é token: a!b@c#9$x.y, then", "a!b@c#9$x.y"), ("secret='pass phrase: 4 wörds!'", "pass phrase: 4 wörds!"), ("go to db://me:p@ss9!@host/x", "p@ss9!"), (f"sent {JWT} on", JWT), ("password=7", "7")]


def test_values_reach_the_forest(spark, make):
    rows = [(i, t, "en", "s") for i, (t, _) in enumerate(TEXTS)]
    got = secrets_scan.scan(make(rows)).collect()
    for i, (t, value) in enumerate(TEXTS):
        at = len(t[: t.index(value)].encode())
        assert [r.by_rule for r in got if (r.doc_id, r.start, r.length) == (i, at, len(value.encode()))] == [True], value
