"""Terms in texts, notice scores and longest matches against plain Python."""

import datetime
import random
import re

import pytest
from tidewatch.operators import terms as T
from tidewatch.plans.linking import checkpoints


@pytest.fixture(autouse=True)
def folder(spark):
    checkpoints(spark)


norm = lambda s: "".join((s or "").split()).lower()
flat = lambda s: " ".join((s or "").split()).lower()


def holds(term, text):
    words = flat(term).split()
    if not words or not all(w in norm(text) for w in words):
        return False
    return len(words) > 1 or len(norm(term)) > 3 or norm(term) in flat(text)


def words_of(r, k):
    return " ".join(r.choice(["dam", "Dams", "fire", "fires", "4 dae", "river", "gang", "x", "old mill", "mill", "nord", "nordsee", "see", "  ", "repair"]) for _ in range(k))


@pytest.mark.parametrize("seed", range(2))
def test_terms_are_found_wherever_they_stand(spark, seed):
    r = random.Random(seed)
    terms = [words_of(r, r.randint(1, 2)) for _ in range(40)] + ["", " ", "x", "x y", "4dae"]
    texts = [words_of(r, r.randint(0, 9)).replace(" ", r.choice([" ", "", "  "])) for _ in range(120)] + [None, ""]
    got = T.find_terms(spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "k long, term string"), spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    want = {(k, i) for k, t in enumerate(terms) for i, x in enumerate(texts) if holds(t, x)}
    rows = [(x.k, x.id) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and want


GENERIC, ACTIONS = ["fires", "river"], ["repair", "gang"]


def score(case, notice, regions):
    """The rules of a title's score, one by one."""
    seen, terms = set(), []
    for text, kind in [(case["facility"], "facility"), *((k, "keyword") for k in case["keywords"] or []), *((k, "promise") for k in case["promise_terms"] or []), (case["region"], "region")]:
        t = flat(text)
        if len(norm(t)) < 2 or norm(t) in seen:
            continue
        seen.add(norm(t))
        common = kind != "region" and all((len(w) <= 3 and not re.search(r"\d", w)) or w in GENERIC for w in t.split())
        weight = 30 if kind == "region" else (40 if len(t.split()) >= 2 else 20) if common else 60 if kind == "facility" else 30
        terms.append((t, kind, weight, common))
    title, snippet = notice["title"], notice["snippet"] or ""
    kept = []
    for t in sorted((t for t in terms if holds(t[0], title)), key=lambda t: -len(norm(t[0]))):
        if not any(norm(t[0]) in norm(k[0]) for k in kept):
            kept.append(t)
    if not kept:
        return None
    total, own = sum(t[2] for t in kept), [norm(o) for o in case["own"] or []]
    foreign = None
    if not any(t[1] == "facility" and not t[3] for t in kept):
        others = sorted((norm(x) for x in regions if holds(x, title) and norm(x) not in own and not any(norm(x) in o for o in own)), key=lambda x: (-len(x), x))
        if others:
            foreign, total = others[0], total - 30
    in_title, in_snippet = any(o in norm(title) for o in own), any(o in norm(snippet) for o in own)
    bonuses = []
    if any(t[1] in ("facility", "region") or not t[3] for t in kept) or in_title or in_snippet:
        acts = [a for a in ACTIONS if a in norm(title)]
        bonuses += [f"action {acts[0]}"] if acts else []
        if notice["published"] and case["occurred"] and -1 <= (notice["published"] - case["occurred"]).days <= 7:
            bonuses.append("recent")
        if norm(snippet) and (any(t[0] not in [k[0] for k in kept] and (t[1] == "region" or (t[1] == "facility" and not t[3])) and holds(t[0], snippet) for t in terms) or (in_snippet and not in_title)):
            bonuses.append("snippet")
    return max(0, min(100, total + 10 * len(bonuses))), "; ".join(t[0] for t in kept), "; ".join(bonuses), foreign


@pytest.mark.parametrize("seed", range(3))
def test_notice_scores_follow_the_rules(spark, seed):
    r = random.Random(seed)
    day = lambda: r.choice([None, datetime.date(2024, 5, r.randint(1, 20))])
    names = ["nord", "nordsee", "see", "dam"]
    cases = [{"case": i, "facility": r.choice([None, "old mill", "dams", "river", "mill"]), "keywords": r.choice([None, [words_of(r, 1) for _ in range(3)], ["fire", "river fires"]]), "promise_terms": r.choice([None, ["repair dam"]]), "region": r.choice([None, "nord", "see"]), "occurred": day(), "own": r.choice([[], ["nordsee"], ["nord"]])} for i in range(25)]
    notices = [{"id": i, "title": words_of(r, r.randint(1, 6)), "snippet": r.choice([None, "", words_of(r, 5)]), "published": day()} for i in range(60)]
    want = {(c["case"], n["id"]): s for c in cases for n in notices if (s := score(c, n, names)) and s[0] >= 30}
    df = spark.createDataFrame([tuple(c.values()) for c in cases], "case long, facility string, keywords array<string>, promise_terms array<string>, region string, occurred date, own array<string>")
    nf = spark.createDataFrame([tuple(n.values()) for n in notices], "id long, title string, snippet string, published date")
    got = T.title_scores(df, nf, spark.createDataFrame([(x,) for x in names], "term string"), ACTIONS, GENERIC, 30)
    assert {(x["case"], x.id): (x.score, x.terms, x.bonuses, x.foreign) for x in got.collect()} == want and len(want) > 30
    assert {f for *_, f in want.values()} - {None} and any("snippet" in b for _, _, b, _ in want.values())


def test_longest_matches(spark):
    r = random.Random(2)
    vocabulary = ["a b", "a b c", "b", "c d e f", "d", "e f", "f g", "g", "A B", "a-b!", ""]
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 25))) for _ in range(150)] + [None, "a, B;c"]
    split = lambda s: tuple(re.findall(r"[^\W_]+", (s or "").lower()))
    shapes = {split(v) for v in vocabulary if split(v)}
    want = set()
    for i, text in enumerate(texts):
        t, k = split(text), 0
        while k < len(t):
            best = max((len(s) for s in shapes if t[k : k + len(s)] == s), default=0)
            if best:
                want |= {(i, k, best, v) for v in vocabulary if split(v) == t[k : k + best]}
            k += best or 1
    d = spark.createDataFrame([(v, "kind", f"parent of {v}") for v in vocabulary], "term string, kind string, parent string")
    rows = T.longest_matches(d, spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    assert {(x.id, x.start, x["size"], x.term) for x in rows} == want and len(rows) == len(want)
    assert T.longest_matches(d.limit(0), spark.createDataFrame(list(enumerate(texts)), "id long, text string")).count() == 0


def test_hits_of_parts_dealt_by_a_column(spark):
    terms = spark.createDataFrame([(1, "dam"), (2, "dam"), (2, "old mill")], "case long, term string")
    texts = spark.createDataFrame([(7, "t", "The old  mill"), (7, "b", "a dam"), (8, "b", "Dams")], "id long, part string, text string")
    found = T.find_terms(terms, texts, T.stands, by="id").groupBy("case", "id").count()
    assert {tuple(x) for x in found.collect()} == {(1, 7, 1), (2, 7, 2), (1, 8, 1), (2, 8, 1)}


def test_runs_of_all_lengths_in_odd_texts(spark):
    wanted = ["a", "ab", "abc", "abcd", "bcde", "\U0001f600x", "ß"]
    texts = ["", "a", "xabcde", "ab\U0001f600xa", "a", "bcd", "aß"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", T.runs_in(wanted)("t").alias("g")).collect()
    assert {r.i: sorted(r.g) for r in got} == {i: sorted(w for w in wanted if w in t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_needles_of_all_lengths_in_odd_texts(spark, monkeypatch, chunk):
    r = random.Random(chunk)
    monkeypatch.setattr(T, "CHUNK", chunk)
    some = lambda k: "".join(r.choice("ab cß\U0001f600댐") for _ in range(k)).strip()
    needles = sorted({" ".join(some(k).split()) for k in (1, 2, 3, 4, 5, 6, 7, 9) for _ in range(30)} - {""}) + ["a" * 30, "댐 ab"]
    texts = [" ".join(some(r.randint(0, 60)).split()) for _ in range(120)] + ["", "a" * 31, "a" * 29, needles[-1], "xaaa" * 9]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1).select("i", T.needles_in(needles)("t").alias("g")).collect()
    assert {r.i: sorted(r.g) for r in got} == {i: [k for k, w in enumerate(needles) if w in t] for i, t in enumerate(texts)}


def test_terms_as_written_against_plain_python(spark):
    """Also terms that differ in case or spaces only, and blank ones; texts are neither moved nor met by each term."""
    r = random.Random(3)
    terms = [words_of(r, r.randint(1, 2)) for _ in range(40)] + ["", " ", None, "Old  Mill", "old mill", "OLD mill"]
    texts = [words_of(r, r.randint(0, 9)).replace(" ", r.choice([" ", "\n", "  "])) for _ in range(120)] + [None, ""]
    t = spark.createDataFrame(list(enumerate(terms)), "k long, term string")
    x = spark.createDataFrame([(i, i // 2, s) for i, s in enumerate(texts)], "id long, pair long, text string")
    want = {(k, i) for k, term in enumerate(terms) for i, s in enumerate(texts) if flat(term) and flat(term) in flat(s)}
    for by in (None, "pair"):
        df = T.find_terms(t, x, T.stands, by=by)
        rows = [(q.k, q.id) for q in df.collect()]
        assert set(rows) == want and len(rows) == len(want) and len(want) > 100
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Contains" not in plan and "text" not in plan.split("ArrowEvalPython")[0]
