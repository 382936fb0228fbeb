"""The gate of linking over all items and documents; words of an item stand for what its case is told by."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import gating as G
from tidewatch.sources.tables import DOCS_SQL, documents, table

from .catalogue import query
from .linking import checkpoints

#: Stand-ins for what a title tells, as regular expressions: a new incident, an act, a name of a place.
FRESH, ACTS, PLACES = "tion|keit|ment", "ing|lich", r"[a-z]{4,}er"
#: Which words of an item (from 1) stand for which kind; facilities are two words.
ROLES = {"region": [1], "org": [4], "alias": [5], "keyword": [6, 7], "expansion": [8], "promise": [9, 10], "exclude": [11], "occurrence": [2], "incident": [3], "near": [1, 12], "parent": [8], "unique": [6, 13]}


def cases_and_terms(spark, d):
    ws = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), 0), lambda x: F.length(x) >= 4)
    w = table(spark, d, "benchmark").select(F.col("item_id").alias("case"), ws.alias("ws")).where(F.size("ws") >= 13)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("case") % 40).cast("int"))
    cases = w.select("case", day.alias("occurred"), F.date_add(day, 10).alias("early_end"), F.date_add(day, 3).alias("first_days"), F.concat(F.lit("c"), (F.col("case") % 3).cast("string")).alias("incident"), (F.col("case") % 4 == 0).alias("wide"), F.slice("ws", 7, 1).alias("allowed"), F.slice("ws", 2, 2).alias("known"))
    facility = F.array_join(F.slice("ws", 2, 2), " ")
    one = lambda kind, term: F.struct(F.lit(kind).alias("kind"), term.alias("term"))
    rows = [one(k, F.get("ws", F.lit(i - 1))) for k, places in ROLES.items() for i in places] + [one("facility", facility), one("place", facility)]
    return cases, w.select("case", F.inline(F.array(*rows))), w.select(F.get("ws", F.lit(0)).alias("term"), F.get("ws", F.lit(7)).alias("parent"))


def gate_articles(spark, d):
    i = F.col("doc_id")
    published = F.when(i % 17 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int")))
    t = F.lower("title")
    return documents(spark, d).select(
        i.alias("article"), "title", F.substr("text", F.length("title") + 2, F.lit(100)).alias("highlight"), F.col("source").alias("keywords"), F.col("text").alias("body"), published.alias("published"), F.array(F.concat(F.lit("c"), (i % 3).cast("string"))).alias("categories"),
        (i % 5 == 0).alias("candidate"), t.rlike(FRESH).alias("fresh"), t.rlike(ACTS).alias("acts"), F.regexp_extract_all(t, F.lit(PLACES), 0).alias("places"),
    )


_in = lambda x, where: f"contains({where}, {x})"
_roles = " UNION ALL ".join(f"SELECT c, '{k}' AS kind, ws[{i}] AS term FROM w" for k, places in ROLES.items() for i in places)
GATE_RULES_SQL = f"""{DOCS_SQL}, w AS (SELECT item_id AS c, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}]+'), lambda x: length(x) >= 4) AS ws FROM benchmark), w13 AS (SELECT * FROM w WHERE len(ws) >= 13),
cs AS (SELECT c, DATE '2024-01-01' + CAST(c % 40 AS INTEGER) AS occurred, 'c' || c % 3 AS incident, c % 4 = 0 AS wide, ws[7] AS allowed, ws[2:3] AS known, ws[1] AS region FROM w13),
tm AS (SELECT DISTINCT c, kind, term FROM ({_roles.replace("FROM w", "FROM w13")} UNION ALL SELECT c, 'facility', ws[2] || ' ' || ws[3] FROM w13 UNION ALL SELECT c, 'place', ws[2] || ' ' || ws[3] FROM w13)),
tk AS (SELECT tm.* FROM tm JOIN cs ON tm.c = cs.c WHERE NOT (kind IN ('org', 'alias') AND contains(term, region))),
flat AS (SELECT doc_id, source, lower(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(coalesce(substr(text, length(title) + 2, 100), ''), '\\s+', ' ', 'g'))) AS h, lower(coalesce(source, '')) AS k, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS b,
  lower(coalesce(title, '')) AS rt, CASE WHEN doc_id % 17 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) END AS published FROM docs),
hit AS (SELECT tk.c, kind, term, doc_id, contains(t, term) AS in_t, contains(h, term) AS in_h, contains(k, term) AS in_k FROM tk JOIN flat ON contains(b, term) OR contains(t, term) OR contains(h, term) OR contains(k, term)),
n AS (SELECT c, doc_id, {", ".join(f"count(DISTINCT term) FILTER (kind IN ({', '.join(repr(k) for k in kinds)}){cond}) AS {name}" for name, kinds, cond in (
    ("region", ["region"], ""), ("facility", ["facility"], ""), ("facility_t", ["facility"], " AND in_t"), ("org", ["org", "alias"], ""), ("seed", ["facility", "keyword"], ""), ("kw", ["facility", "keyword", "expansion"], ""), ("promise", ["promise"], ""), ("exclude", ["exclude"], " AND in_t"), ("first", ["occurrence"], ""),
    ("near_head", ["near"], " AND (in_t OR in_h OR in_k)"), ("near_t", ["near"], " AND in_t"), ("place_head", ["place"], " AND (in_t OR in_h OR in_k)"), ("place_t", ["place"], " AND in_t"), ("uniq", ["unique"], ""), ("uniq_th", ["unique"], " AND (in_t OR in_h)"), ("uniq_t", ["unique"], " AND in_t"),
    ("parent_head", ["parent"], " AND (in_t OR in_h OR in_k)"), ("incident_t", ["incident"], " AND in_t"), ("promise_head", ["promise"], " AND (in_t OR in_h OR in_k)"), ("promise_t", ["promise"], " AND in_t")))} FROM hit GROUP BY 1, 2),
rg AS (SELECT DISTINCT ws[1] AS term, ws[8] AS parent FROM w13), nm AS (SELECT doc_id, list({{'term': term, 'parent': parent}}) AS named FROM rg JOIN flat ON contains(t, term) GROUP BY 1),
own AS (SELECT c, list(term) FILTER (kind = 'near') AS near, list(term) FILTER (kind = 'parent') AS parents FROM tm GROUP BY 1),
j AS (SELECT n.*, cs.*, own.near, own.parents, flat.published, flat.rt, coalesce(named, []) AS named, regexp_matches(rt, '{FRESH}') AS fresh, regexp_matches(rt, '{ACTS}') AS acts, regexp_extract_all(rt, '{PLACES}') AS places, 'c' || n.doc_id % 3 = cs.incident AS inc
  FROM n JOIN cs ON n.c = cs.c JOIN own ON own.c = n.c JOIN flat ON flat.doc_id = n.doc_id LEFT JOIN nm ON nm.doc_id = n.doc_id WHERE n.region + facility + org > 0),
r AS (SELECT *, coalesce(published >= occurred - 1, false) AS dated, inc OR kw >= 2 OR promise >= 2 OR facility > 0 AS topic FROM (SELECT * EXCLUDE (c_1, region_1), c AS cc FROM j)),
x AS (SELECT *, NOT topic AND coalesce(published <= occurred + 3, false) AND first > 0 AS occ,
  wide AND uniq = 0 AND NOT (incident_t > 0 AND (near_t > 0 OR len(list_filter(named, lambda q: list_contains(parents, q.parent))) > 0)) AS x_wide,
  NOT wide AND near_head = 0 AND place_head = 0 AND NOT (parent_head > 0 AND uniq_th > 0) AS x_region,
  len(list_filter(named, lambda q: NOT list_contains(near, q.term) AND NOT list_contains(parents, q.term) AND q.term <> allowed)) > 0 AND place_t = 0 AND near_t = 0 AND len(list_filter(named, lambda q: q.term = allowed)) = 0 AND NOT (uniq_t > 0 AND NOT fresh) AS x_other,
  coalesce(published > occurred + 10, false) AS late, uniq_th > 0 OR promise_head >= 2 AS late_ok,
  uniq_t = 0 AND fresh AND len(list_filter(places, lambda p: len(list_filter(known, lambda q: contains(q, p) OR contains(p, q))) = 0)) > 0 AS cap_place FROM r),
y AS (SELECT *, late AND NOT late_ok AS x_late, late AND late_ok AND fresh AND promise_t = 0 AND NOT acts AS cap_recur, topic OR occ AS inside FROM x),
z AS (SELECT *, dated AND exclude = 0 AND inside AND NOT x_wide AND NOT x_region AND NOT x_other AND NOT x_late AS passed FROM y)"""


@query(f"""WITH {GATE_RULES_SQL} SELECT cc AS item_id, doc_id, passed, dated AND exclude = 0 AND inside AND (cap_recur OR cap_place) AS capped,
  passed AND ((facility_t > 0 AND (region > 0 OR org > 0 OR inc)) OR (facility > 0 AND (region > 0 OR org > 0)) OR (org > 0 AND promise >= 2) OR (doc_id % 5 = 0 AND (region > 0 OR org > 0) AND promise >= 2) OR ((region > 0 OR org > 0) AND promise >= 2 AND (facility > 0 OR seed > 0))) AS strong,
  CASE WHEN NOT dated THEN 'date' WHEN exclude > 0 THEN 'x-exclude' ELSE concat_ws('+', CASE WHEN region > 0 THEN 'region' END, CASE WHEN facility > 0 THEN 'facility' END, CASE WHEN facility_t > 0 THEN 'facility-title' END, CASE WHEN org > 0 THEN 'org' END, CASE WHEN inc THEN 'incident' END, CASE WHEN seed > 0 THEN 'seed' END,
    CASE WHEN kw >= 2 THEN 'kw' END, CASE WHEN promise >= 2 THEN 'promise' END, CASE WHEN occ THEN 'occ-window' END, CASE WHEN inside AND x_wide THEN 'x-wide' END, CASE WHEN inside AND x_region THEN 'x-region' END, CASE WHEN inside AND x_other THEN 'x-other' END, CASE WHEN inside AND x_late THEN 'x-late' END, CASE WHEN inside AND cap_recur THEN 'cap-recur' END, CASE WHEN inside AND cap_place THEN 'cap-place' END) END AS reasons FROM z""")
def q_gate_rules(spark, d):
    """Every pair of an item and a document in scope: whether it passes, is capped, is strong, and why."""
    checkpoints(spark)
    cases, terms, regions = cases_and_terms(spark, d)
    return G.gate(cases, terms, gate_articles(spark, d), regions).withColumnsRenamed({"case": "item_id", "article": "doc_id"})
