"""Incident groups against all pairs, their names, and turns over strata against a loop."""

import datetime
import random
from collections import Counter

import pytest
from tidewatch.operators import grouping as G
from tidewatch.plans.linking import checkpoints

QUOTE = "id long, day date, speaker string, quotation string, facility string, regions array<string>, families array<string>, org string, news_id string, strength string, kind string, occurred boolean, preventive boolean, casualties int"


@pytest.fixture(autouse=True)
def folder(spark):
    checkpoints(spark)


def quotes(seed, n=160):
    r = random.Random(seed)
    some = lambda xs, k: [x for x in xs if r.random() < k]
    for i in range(n):
        day = None if r.random() < 0.03 else datetime.date(2024, 1, 1) + datetime.timedelta(days=r.randint(0, 900))
        yield (i, day, r.choice(["mayor", "chief", None, f"s{i}"]), r.choice(["we will act" * 5, f"words {i}", None]), r.choice(["", None, None, "dam", "mill"]), r.choice([None, some(["A", "B", "C", ""], 0.4)]), r.choice([None, some(["fire", "water"], 0.5)]), r.choice(["city", "state", "", None]), f"n{r.randint(0, n)}", r.choice(["firm", "plan", None]), r.choice(["fire", "flood"]), r.random() < 0.5, r.random() < 0.3, r.choice([None, 0, 3]))


def same(a, b):
    if a[1] is None or b[1] is None or abs((a[1] - b[1]).days) > 14:
        return False
    if (a[3] or "")[:40] == (b[3] or "")[:40] and (a[2] or "") == (b[2] or ""):
        return True
    if a[4] and a[4] == b[4]:
        return True
    fam = set(a[6] or []) & set(b[6] or [])
    ra, rb = ({x for x in q[5] or [] if x} for q in (a, b))
    return bool(ra & rb and fam) or bool(a[7] and a[7] == b[7] and fam and (ra & rb or (not ra and not rb)))


def grouped(rows):
    label = {q[0]: q[0] for q in rows}
    changed = True
    pairs = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if same(a, b)]
    while changed:
        changed = False
        for x, y in pairs:
            m = min(label[x], label[y])
            changed |= label[x] != m or label[y] != m
            label[x] = label[y] = m
    return label


@pytest.mark.parametrize("seed", range(3))
def test_groups_and_names_equal_all_pairs(spark, seed):
    rows = list(quotes(seed))
    df = spark.createDataFrame(rows, QUOTE)
    found = G.event_groups(df).checkpoint()
    label = grouped(rows)
    assert {r.id: r.grp for r in found.collect()} == label and len(set(label.values())) > 20
    got = {r.grp: r for r in G.describe_groups(df, found).collect()}
    far = datetime.date(1, 1, 1)
    for g in set(label.values()):
        own = sorted((q for q in rows if label[q[0]] == g), key=lambda q: (q[1] or far, q[0]))
        rep = min(own, key=lambda q: (q[1] or far, {"firm": 0, "plan": 1}.get(q[9], 2), q[8], q[0]))
        orgs = Counter()
        for q in own:
            if q[7]:
                orgs[q[7]] += 2 if q is rep else 1
        first = lambda c: c.most_common(1)[0][0] if c else None
        org, region = first(orgs), first(Counter(x for q in own for x in q[5] or [] if x))
        place, kind = first(Counter(q[4] for q in own if q[4])), first(Counter(q[10] for q in own))
        hurt = any(q[13] for q in own)
        score = 30 * (rep[11] and not rep[12]) - 40 * bool(rep[12] and not (place or hurt)) + 20 * bool(place) + 20 * bool(region) + 10 * any(q[9] == "firm" for q in own) + 10 * hurt + (10 if org else -10) + 3 * min(6, len({q[8] for q in own}))
        assert (got[g].rep, got[g].org, got[g].region, got[g].facility, got[g].kind, got[g].score) == (rep[0], org, region, place, kind, score)


def test_a_key_that_all_share_makes_no_pairs(spark):
    rows = [(i, datetime.date(2024, 1, 1) + datetime.timedelta(days=i % 50 * 10), None, f"q{i}", "dam", None, None, None, "n", None, "k", None, None, None) for i in range(3000)]
    found = G.event_groups(spark.createDataFrame(rows, QUOTE))
    assert {r.grp for r in found.collect()} == {0}
    assert G.event_groups(spark.createDataFrame([], QUOTE)).count() == 0


@pytest.mark.parametrize("limit", [5, 40, 300])
def test_turns_over_strata(spark, limit):
    r = random.Random(limit)
    rows = [(i, r.choice("abc"), datetime.date(2020 + r.randint(0, 2), 1, 1 + r.randint(0, 27)), r.randint(-10, 60)) for i in range(120)]
    strata = {}
    for g in sorted(rows, key=lambda g: (-g[3], g[2], g[0])):
        strata.setdefault((g[1], g[2].year), []).append(g)
    picked = []
    for floor in (20, -999):
        while len(picked) < limit:
            before = len(picked)
            for k in sorted(strata):
                if strata[k] and strata[k][0][3] >= floor and len(picked) < limit:
                    picked.append(strata[k].pop(0)[0])
            if len(picked) == before:
                break
    got = G.select_groups(spark.createDataFrame(rows, "rep long, kind string, day date, score int"), limit)
    assert sorted(x.rep for x in got.collect()) == sorted(picked)


def test_what_is_linked_are_runs_and_not_quotations(spark, monkeypatch):
    sizes, real = [], G.components
    monkeypatch.setattr(G, "components", lambda edges: (sizes.append(edges.count()), real(edges))[1])
    day = datetime.date(2024, 1, 1)
    rows = [(i, day, None, f"q{i}", "dam", None, None, None, "n", None, "k", None, None, None) for i in range(500)]
    rows += [(500, day, None, "q", "dam", ["A"], ["fire"], None, "n", None, "k", None, None, None), (501, day, None, "r", None, ["A"], ["fire"], None, "n", None, "k", None, None, None)]
    assert {r.grp for r in G.event_groups(spark.createDataFrame(rows, QUOTE)).collect()} == {0} and sizes == [1]
