import random
import re

from cohortloom.llm import secrets
from tests.llm.helpers import empty_docs, odd_docs

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def base(text):
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def brute(text, scope):
    known = base(text)
    weak = [
        (m.start(), kind, m.end())
        for kind in secrets.WEAK
        for m in re.finditer(secrets.PATTERNS[kind], text)
    ]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in known)]
    linked = [
        w
        for w in weak
        if any(
            p[1] in secrets.PARTNERS[w[1]] and p[0] <= w[2] + scope and w[0] <= p[2] + scope
            for p in known + weak
        )
    ]
    kinds = (*secrets.BASE, *secrets.WEAK)
    return sorted(known + linked, key=lambda s: (s[0], kinds.index(s[1])))


def found(docs, **how):
    return {
        r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["secrets"]]
        for r in secrets.scan(docs, **how).collect()
    }


def test_brute_force(spark):
    rng = random.Random(8)
    parts = [
        "password = 'abc123x'", "SECRET:q", "token: passwd: abcdefgh", "api_key=a.b-c/d+e=f", "AKIA" + "Z9" * 8,
        "AKIA" + "Q" * 10, "AKIAAKIA" + "A1" * 9, "0123456789abcdef" * 2, "deadbeef", "Ab1" * 12, "login: bob.smith",
        "https://db.example.org:80/x?y=1", "é", "日本", " ", "\n", "word " * 20, "0" * 24, "user=ann", "secret=token=abcdef",
    ]
    rows = [(i, rng.choice(["", " ", "-"]).join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for scope in (0, 30, 200):
        if scope:
            assert found(docs, scope=scope) == {d: brute(t, scope) for d, t in rows}
    assert sum(len(base(t)) for _, t in rows) > 100


def test_weak_parts_need_their_complement(spark):
    token = "Ab1" * 12
    rows = [(1, token), (2, f"login=bobby {token}"), (3, f"login=bobby {'.' * 300} {token}"), (4, "https://x.org/")]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[1] == got[3] == got[4] == []
    assert [k for _, k, _ in got[2]] == ["identifier", "token"]


def test_odd_rows(spark):
    docs = odd_docs(spark, ["password: abcdefg", "password: abcdefg"])
    result = secrets.scan(docs)
    assert result.count() == docs.count() and result.columns[-1] == "secrets"
    got = found(docs)
    assert got[2] == got[3] == got[4] == [] and got[100] == got[101] == [(0, "assign", 17)]
    assert secrets.scan(empty_docs(spark)).count() == 0
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_rows_and_null_ids_are_not_mixed(spark):
    rows = [(None, "password: abcdefg"), (None, "x"), (7, "password: abcdefg"), (7, "password: abcdefg"), (7, "x")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5
    assert all(len(r["secrets"]) == (1 if r["text"] != "x" else 0) for r in got)
