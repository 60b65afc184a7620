import re

from confab.llm import secret_scans as ss
from tests.llm.support import awkward, table

SECRETS = [
    (30, 'password = "hunter22" and token:abc, token: abcdef', None),
    (31, "😀 key AKIA" + "A1" * 8 + " then " + "0a" * 13 + " AKIASHORT", None),
    (32, "token: token: abcdefgh api_key='x' API-KEY=zzzzzzzz", None),
    (33, "login=walter then Zx9" + "aB3" * 8 + " at https://h.example/x?y", None),
    (34, "just Zx9" + "aB3" * 8 + " and https://h.example/x", None),
    (35, "user: bob" + " pad" * 100 + " Zx9" + "aB3" * 8, None),
    (36, "secret=" + "v" * 4000 + "\npasswd:==== " * 50, None),
    (37, "postgres://db password=abcdefgh login=ann", None),
    (38, "login=Zx9" + "aB3" * 10, None),
    (39, "see https://h.example/Zx9" + "aB3" * 8 + " there", None),
    (40, "login=Zx9" + "aB3" * 10 + " password=abcdefgh https://h.example/Zx9" + "aB3" * 8 + " user=bobby", None),
    (41, "user=bob token=abc123 " * 700 + "Zx9" + "aB3" * 8, None),
]


def base(text):
    out = []
    text = text or ""
    for n, (pattern, group, least) in enumerate(((ss.ASSIGN, 2, 6), (ss.ACCESS, 0, 20), ("[0-9a-f]+", 0, 24))):
        out += [(m.start(), n, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out)


def linked(text):
    """The rule, pair by pair: disjoint weak parts with complementary disjoint parts that start in scope."""
    text = text or ""
    strong = [(s, e, ss.KINDS[n], ss.BASE[n][-1]) for s, n, e in base(text)]
    weak = [(m.start(), m.end(), kind, role) for kind, p, role in ss.WEAK for m in re.finditer(p, text)]
    cross = lambda a, b: a is not b and a[0] < b[1] and b[0] < a[1]
    above = {"weak_id": (), "weak_secret": ("weak_id",), "weak_endpoint": ("weak_id", "weak_secret")}
    free = [w for w in weak if not any(cross(w, o) for o in strong) and not any(cross(w, o) and o[2] in above[w[2]] for o in weak)]
    hears = lambda w, role: any(o[3] == role and not cross(w, o) and o is not w and abs(o[0] - w[0]) <= ss.SCOPE for o in strong + free)
    needs = {"id": ["secret"], "secret": ["id"], "endpoint": ["id", "secret"]}
    stay = strong + [w for w in free if all(hears(w, r) for r in needs[w[3]])]
    return sorted((s, ss.KINDS.index(kind), e) for s, e, kind, _ in stay)


def test_spans_match_brute_force(spark):
    rows = [*awkward(), *SECRETS, SECRETS[3], (None, SECRETS[3][1], None)]
    named = lambda spans: [(ss.KINDS[n], s, e) for s, n, e in spans]
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.base], [tuple(x) for x in r.spans]) for r in ss.scan_secrets(table(spark, rows)).collect()))
    assert got == sorted((d or 0, named(base(t)), named(linked(t))) for d, t, _ in rows)
    spans = {d: {x[0] for x in s} for d, _, s in got}
    assert "weak_secret" in spans[33] and "weak_endpoint" in spans[33] and not spans[34] and not spans[35]
    assert not spans[38] and not spans[39] and "weak_endpoint" not in spans[40]


def test_empty_table(spark):
    assert ss.scan_secrets(table(spark, [])).collect() == []


def test_long_keys_whose_classes_come_late(spark):
    keys = ["aB" * 40 + "3", "A1" * 40 + "b", "x1" * 40 + "B", "x" * 5000 + "B3"]
    rows = [(i, f"login=walter then {key} end", None) for i, key in enumerate(keys)]
    got = {r.doc_id: {(x.kind, x.start, x.end) for x in r.spans} for r in ss.scan_secrets(table(spark, rows)).collect()}
    assert all(("weak_secret", 18, 18 + len(key)) in got[i] for i, key in enumerate(keys))


def test_many_matches_take_time_in_proportion(spark):
    text = "token=abcdef user=bobby " * 40_000
    row = ss.scan_secrets(table(spark, [(1, text, None)])).first()
    assert len(row.base) == 40_000 and len(row.spans) == 80_000
    assert [(x.start, x.end) for x in row.base[-2:]] == [(24 * 39_998, 24 * 39_998 + 12), (24 * 39_999, 24 * 39_999 + 12)]
