"""What the rules read out of texts: promises, signals, actors and mentions; scalar ladders and label metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import dates as D
from tidewatch.functions import text as X
from tidewatch.operators import extraction as E
from tidewatch.operators import relevance as R
from tidewatch.sources.tables import CASES_SQL, LINKS_SQL, cases, documents, links, table

from .catalogue import query

WORDS = E.Expressions("mente|schpf|èque", "tion|keit|ment", "est|ist|ait", "was|von|pour", "all|ganz|tout")
VOWS = E.Commitment("tion|keit|ment", "est|ist|ait", "ation|heit|eur", "was|von|pour", "that|dass|dans", "ing|lich|ique")
SENTENCES = r"SELECT {key}, s, min(i) AS i FROM (SELECT {key}, trim(unnest(x), ' ') AS s, generate_subscripts(x, 1) AS i FROM (SELECT {key}, regexp_split_to_array({text}, '[.!?\n]+') AS x FROM {table})) WHERE length(s) >= 4 GROUP BY {key}, s"
TERMS = {"en": ["the", "and", "of"], "de": ["und", "der", "die"], "fr": ["que", "par", "dans"], "es": ["que", "con", "los"]}
_has = lambda c, p: f"regexp_matches({c}, '{p}')"


@query(f"""WITH s AS ({SENTENCES.format(key="doc_id, lang", text="lower(text)", table="documents")}),
t(lang, terms) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in TERMS.items())}),
h AS (SELECT doc_id, s, i, least(1000, length(s) * 4) AS w, len(list_filter(terms, lambda x: contains(s, x))) AS hits,
  CASE WHEN {_has("s", WORDS.problem)} THEN 3 WHEN {_has("s", WORDS.done)} THEN CASE WHEN {_has("s", WORDS.partial)} AND NOT {_has("s", WORDS.whole)} THEN 1 ELSE 2 END WHEN {_has("s", WORDS.progress)} THEN 1 ELSE 0 END AS k
  FROM s JOIN t USING (lang)), r AS (SELECT *, hits * 1000 // 3 + w AS near FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY near DESC, i) AS place, max(k) OVER (PARTITION BY doc_id) AS seen FROM r),
b AS (SELECT doc_id, s, w, k, least(hits, 2) AS overlap, row_number() OVER (PARTITION BY doc_id ORDER BY least(hits, 2) DESC, k DESC, near DESC, i) AS n FROM o WHERE place <= 3 AND k > 0 AND (hits > 0 OR w >= 800))
SELECT d.doc_id, CASE WHEN b.k = 3 THEN 'problem' WHEN b.k = 2 THEN 'done' WHEN b.k = 1 THEN 'progress' WHEN o.seen > 0 THEN 'unclear' ELSE 'unrelated' END AS signal,
  CAST(CASE WHEN b.k IS NOT NULL THEN greatest(30, least(90, CASE overlap WHEN 2 THEN 75 WHEN 1 THEN 65 ELSE 60 END + floor((w - 500) / 50))) WHEN o.seen > 0 THEN 40 ELSE 60 END AS INTEGER) AS conf,
  CAST(coalesce(overlap, 0) AS INTEGER) AS overlap, coalesce(substr(s, 1, 100), '') AS span
FROM documents d LEFT JOIN (SELECT doc_id, max(seen) AS seen FROM o GROUP BY doc_id) o USING (doc_id) LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING (doc_id)""")
def q_signal_classify(spark, d):
    terms = F.coalesce(*(F.when(F.col("lang") == k, F.array(*map(F.lit, v))) for k, v in TERMS.items()))
    docs = table(spark, d, "documents").select("doc_id", "text", terms.alias("terms"))
    return E.classify(docs, WORDS, lambda s: F.least(F.lit(1000), F.length(s) * 4))


GRAMS_SQL = "CASE WHEN length({t}) >= 2 THEN list_transform(range(1, length({t})), lambda i: CAST('0x' || substr(md5(substr(lower({t}), i, 2)), 1, 4) AS INTEGER) % 64) ELSE [] END"


@query(f"""WITH pw AS (SELECT item_id, 'src' || item_id % 20 AS source, lower(split_part(text, '.', 1)) AS action, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}]+'), lambda x: length(x) >= 4)[:3] AS terms FROM benchmark),
raw AS ({SENTENCES.format(key="doc_id, source", text="lower(text)", table="documents")}),
s AS (SELECT doc_id, source, s, i, least(1000, length(s) * 4) AS w, CASE WHEN {_has("s", WORDS.problem)} THEN 3 WHEN {_has("s", WORDS.done)} THEN CASE WHEN {_has("s", WORDS.partial)} AND NOT {_has("s", WORDS.whole)} THEN 1 ELSE 2 END WHEN {_has("s", WORDS.progress)} THEN 1 ELSE 0 END AS k FROM raw),
sv AS (SELECT s, b, count(*) AS n FROM (SELECT s, unnest({GRAMS_SQL.format(t="s")}) AS b FROM (SELECT DISTINCT s FROM s)) GROUP BY 1, 2), sn AS (SELECT s, sum(n * n) AS q FROM sv GROUP BY 1),
pv AS (SELECT item_id, b, count(*) AS n FROM (SELECT item_id, unnest({GRAMS_SQL.format(t="action")}) AS b FROM pw) GROUP BY 1, 2), pn AS (SELECT item_id, sum(n * n) AS q FROM pv GROUP BY 1),
pairs AS (SELECT s.*, p.item_id, p.terms FROM s JOIN pw p ON s.source = p.source),
dots AS (SELECT x.s, x.item_id, sum(sv.n * pv.n) AS d FROM (SELECT DISTINCT s, item_id FROM pairs) x JOIN sv ON sv.s = x.s JOIN pv ON pv.item_id = x.item_id AND pv.b = sv.b GROUP BY 1, 2),
c AS (SELECT pairs.doc_id, pairs.i, pairs.item_id, CAST(coalesce(floor(1000 * d / sqrt(CAST(sn.q * pn.q AS DOUBLE)) + 0.5), 0) AS INTEGER) AS cos, len(list_filter(terms, lambda t: contains(pairs.s, t))) AS hits
  FROM pairs LEFT JOIN dots ON dots.s = pairs.s AND dots.item_id = pairs.item_id LEFT JOIN sn ON sn.s = pairs.s LEFT JOIN pn ON pn.item_id = pairs.item_id),
m AS (SELECT doc_id, i, max(cos) AS near, max(hits) AS hits, arg_max(item_id, {{'c': cos, 'p': -item_id}}) AS nearest, arg_max(item_id, {{'h': hits, 'p': -item_id}}) AS most FROM c GROUP BY 1, 2),
r AS (SELECT s.doc_id, s.i, s.s, s.w, s.k, coalesce(near, 0) AS near, coalesce(hits, 0) AS hits, nearest, most, coalesce(near, 0) + w AS rel FROM s LEFT JOIN m ON m.doc_id = s.doc_id AND m.i = s.i),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rel DESC, i) AS place, max(k) OVER (PARTITION BY doc_id) AS seen FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY least(hits, 2) DESC, k DESC, rel DESC, i) AS n FROM o WHERE place <= 3 AND k > 0 AND (hits > 0 OR (w >= 800 AND nearest IS NOT NULL)))
SELECT d.doc_id, CASE WHEN b.k = 3 THEN 'problem' WHEN b.k = 2 THEN 'done' WHEN b.k = 1 THEN 'progress' WHEN o.seen > 0 THEN 'unclear' ELSE 'unrelated' END AS signal, CASE WHEN b.hits > 0 THEN b.most ELSE b.nearest END AS promise,
  CAST(CASE WHEN b.k IS NOT NULL THEN greatest(300, least(900, CASE least(hits, 2) WHEN 2 THEN 750 WHEN 1 THEN 650 ELSE 600 END + floor((2 * w + near - 1495) / 10))) WHEN o.seen > 0 THEN 400 ELSE 600 END AS INTEGER) AS conf,
  CAST(CASE WHEN b.k IS NULL THEN 0 ELSE least(hits, 2) END AS INTEGER) AS overlap, CAST(coalesce(near, 0) AS INTEGER) AS near, coalesce(substr(s, 1, 100), '') AS span
FROM documents d LEFT JOIN (SELECT doc_id, max(seen) AS seen FROM o GROUP BY doc_id) o USING (doc_id) LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING (doc_id)""")
def q_sentence_relevance(spark, d):
    """Documents against the promises of their source: items stand for promises, their first sentence for the action."""
    terms = F.slice(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), 0), lambda x: F.length(x) >= 4), 1, 3)
    p = table(spark, d, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("case"), F.col("item_id").alias("promise"), F.substring_index("text", ".", 1).alias("action"), terms.alias("terms"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("case"), "text")
    return R.sentence_signals(docs, p, WORDS, lambda s: F.least(F.lit(1000), F.length(s) * 4)).withColumnRenamed("id", "doc_id")


@query(rf"""WITH v AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'problem' ELSE 'unrelated' END AS signal, CAST(50 + doc_id % 40 AS INTEGER) AS conf,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'not in any text' WHEN 2 THEN substr(text, 1, 120) ELSE substr(text, 3, 60) END AS raw FROM documents),
t AS (SELECT *, trim(raw, ' ') AS span FROM v),
c AS (SELECT *, (signal <> 'unrelated' AND (span = '' OR length(span) > 100)) OR NOT contains(regexp_replace(text, '\s', '', 'g'), regexp_replace(span, '\s', '', 'g')) AS bad FROM t)
SELECT doc_id, CASE WHEN bad THEN 'unclear' WHEN signal = 'done' AND {_has("span", WORDS.partial)} AND NOT {_has("span", WORDS.whole)} THEN 'progress' ELSE signal END AS signal, CASE WHEN bad THEN least(conf, 30) ELSE conf END AS conf FROM c""")
def q_span_validate(spark, d):
    i, t = F.col("doc_id"), F.col("text")
    signal = F.when(i % 3 == 0, "done").when(i % 3 == 1, "problem").otherwise("unrelated")
    span = F.when(i % 5 == 0, "").when(i % 5 == 1, "not in any text").when(i % 5 == 2, F.substring(t, 1, 120)).otherwise(F.substring(t, 3, 60))
    return table(spark, d, "documents").select("doc_id", E.validated(signal, (50 + i % 40).cast("int"), span, t, WORDS).alias("v")).select("doc_id", "v.*")


_bound = f"({_has('s', VOWS.modal)} OR {_has('s', VOWS.firm)})"
PROMISES_FOUND_SQL = f"""s AS ({SENTENCES.format(key="conv_id, turn, role", text="lower(text)", table="conversations")}),
p AS (SELECT conv_id, turn, role, s, i, CASE WHEN contains(s, 'the') THEN last_day(DATE '2000-01-01' + CAST(turn * 30 AS INTEGER)) END AS deadline FROM s WHERE {_bound}),
q AS (SELECT *, CASE WHEN {_has("s", VOWS.directive)} AND NOT {_has("s", VOWS.own)} THEN 'intention' WHEN {_has("s", VOWS.soft)} AND NOT {_has("s", VOWS.firm)} THEN 'intention'
  WHEN deadline IS NOT NULL THEN 'firm' WHEN {_has("s", VOWS.concrete)} THEN 'plan' WHEN {_has("s", VOWS.modal)} THEN 'intention' ELSE 'none' END AS strength,
  list_sort(list_transform(list_filter(list_transform(regexp_split_to_array(s, '[,;:]'), lambda c: trim(c, ' ')), lambda c: length(c) BETWEEN 4 AND 40), lambda c: {{'n': length(c), 'c': c}}), 'DESC')[1].c AS action FROM p),
found AS (SELECT conv_id, turn, role, deadline, strength, action, CAST(CASE strength WHEN 'firm' THEN 80 WHEN 'plan' THEN 70 WHEN 'intention' THEN 60 ELSE 50 END AS INTEGER) AS confidence, strength IN ('firm', 'plan') AND action IS NOT NULL AS trackable FROM q)"""


def _promises(spark, d):
    quotes = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    due = F.last_day(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("turn") * 30).cast("int")))
    return E.promises(quotes, VOWS, lambda s: F.when(F.contains(s, F.lit("the")), due)).drop("sentence")


@query(f"WITH {PROMISES_FOUND_SQL} SELECT * FROM found")
def q_promise_extract(spark, d):
    return _promises(spark, d)


ACTORS = dict(public="of|und|de", private="th|sch|ion", title="^assistant the|^user a")


def _actor():
    return F.concat_ws(" ", "role", F.substring_index("text", " ", 2))


ACTOR_SQL = "lower(role || ' ' || array_to_string(list_slice(string_split(text, ' '), 1, 2), ' '))"
CLASS_SQL = f"CASE WHEN {_has(ACTOR_SQL, ACTORS['title'])} THEN 'public' WHEN {_has(ACTOR_SQL, ACTORS['private'])} THEN 'private' WHEN {_has(ACTOR_SQL, ACTORS['public'])} THEN 'public' ELSE 'unknown' END"


@query(f"SELECT conv_id, turn, {CLASS_SQL} AS class FROM conversations")
def q_actor_classify(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", E.actor_class(_actor(), **ACTORS).alias("class"))


@query(f"""WITH {PROMISES_FOUND_SQL}, a AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE {CLASS_SQL} = 'public')
SELECT conv_id, count(*) AS quotes, min({{'k': -confidence, 'turn': turn, 'action': action}}).action AS best FROM found JOIN a USING (conv_id, turn) WHERE trackable GROUP BY conv_id""")
def q_source_quotes(spark, d):
    """Conversations in which a public actor commits: how often, and the strongest, earliest act."""
    public = table(spark, d, "conversations").where(E.actor_class(_actor(), **ACTORS) == "public").select("conv_id", "turn").distinct()
    kept = _promises(spark, d).where("trackable").join(public, ["conv_id", "turn"])
    first = F.min(F.struct((-F.col("confidence")).alias("k"), "turn", "action")).getField("action")
    return kept.groupBy("conv_id").agg(F.count("*").alias("quotes"), first.alias("best"))


_words = r"list_distinct(list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= {} AND NOT regexp_full_match(w, '\p{{N}}+')))"


@query(f"""WITH w AS (SELECT source, w, count(*) AS n FROM (SELECT source, unnest({_words.format("text", 6)}) AS w FROM documents) GROUP BY ALL),
q AS (SELECT source, w FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS rn FROM w) WHERE rn <= 2),
h AS (SELECT q.source, d.doc_id FROM (SELECT doc_id, source, unnest({_words.format("text", 6)}) AS w FROM documents) d JOIN q ON d.w = q.w AND d.source <> q.source GROUP BY ALL HAVING count(*) = 2)
SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM h) WHERE rn <= 20""")
def q_promise_research(spark, d):
    """A narrow query for each source (its two most frequent long words) over the other sources, the newest 20 hits (the budget)."""
    w = table(spark, d, "documents").select("doc_id", "source", F.explode(X.distinct_tokens(F.col("text"), 6)).alias("w"))
    counts = w.groupBy("source", "w").agg(F.count("*").alias("n"))
    top = counts.groupBy("source").agg(F.min_by("w", F.struct(-F.col("n"), "w")).alias("w1"))
    rest = counts.join(top, "source").where("w <> w1").groupBy("source").agg(F.min_by("w", F.struct(-F.col("n"), "w")).alias("w"))
    asked = top.select(F.col("source").alias("own"), F.col("w1").alias("w")).unionByName(rest.select(F.col("source").alias("own"), "w"))
    hits = w.join(asked, "w").where("source <> own").groupBy(F.col("own").alias("source"), "doc_id").agg(F.count("*").alias("n")).where("n = 2")
    ranked = hits.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id"))))
    return ranked.where("rn <= 20").select("source", "doc_id")


KINDS = {"aid": "tion|keit", "money": "est|ist", "visit": "mente|ment"}


@query(rf"""WITH s AS (SELECT doc_id, s FROM ({SENTENCES.format(key="doc_id", text="text", table="documents")})), k(kind, p) AS (VALUES {", ".join(f"('{k}', '{p}')" for k, p in KINDS.items())}),
m AS (SELECT DISTINCT doc_id, kind, unnest(regexp_extract_all(s, '[A-Z][a-z]{{3,}}')) AS actor FROM s JOIN k ON regexp_matches(lower(s), p))
SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.kind = m.kind AND length(o.actor) > length(m.actor) AND contains(o.actor, m.actor))""")
def q_support_mentions(spark, d):
    return E.mentions(table(spark, d, "documents"), key="doc_id", text_col="text", actor="[A-Z][a-z]{3,}", kinds=KINDS)


LINK_CASE_SQL = f"WITH {LINKS_SQL}, {CASES_SQL}, x AS (SELECT l.*, occurred, date_diff('day', occurred, pub) AS days FROM links l JOIN cases c ON l.case_id = c.case_id)"


def _link_days(spark, d):
    return links(spark, d).join(cases(spark, d).select("case_id", "occurred"), "case_id").withColumn("days", F.datediff("pub", "occurred"))


@query(f"{LINK_CASE_SQL} SELECT case_id, part, supp, line, round(sign(days) * ln(1 + abs(days)), 6) AS x FROM x")
def q_signed_log(spark, d):
    return _link_days(spark, d).select("case_id", "part", "supp", "line", F.round(D.signed_log(F.col("days")), 6).alias("x"))


@query(f"{LINK_CASE_SQL} SELECT case_id, part, supp, line FROM x WHERE days BETWEEN -1 AND 14")
def q_core_window(spark, d):
    """Links from the day before a case to a fortnight after it: the core that its terms are learned from."""
    return _link_days(spark, d).where("days BETWEEN -1 AND 14").select("case_id", "part", "supp", "line")


@query(f"WITH {CASES_SQL} SELECT case_id, strftime(occurred, '%Y%m%d') AS compact, strftime(occurred, '%Y.%m.%d') AS dotted, month(occurred) || '/' || day(occurred) AS short, year(occurred) || ' Q' || quarter(occurred) AS quarter FROM cases")
def q_format_dates(spark, d):
    o = F.col("occurred")
    text = lambda f: f(o).cast("string")
    return cases(spark, d).select(
        "case_id", F.date_format(o, "yyyyMMdd").alias("compact"), F.date_format(o, "yyyy.MM.dd").alias("dotted"), F.concat(text(F.month), F.lit("/"), text(F.dayofmonth)).alias("short"), F.concat(text(F.year), F.lit(" Q"), text(F.quarter)).alias("quarter")
    )


@query("""SELECT coalesce(source, 'all') AS source, count(*) AS n, count_if(quality = 1 AND n_chars > 500) AS hits, count_if(n_chars > 500) AS said, count_if(quality = 1) AS truth,
CASE WHEN count_if(n_chars > 500) > 0 THEN round(count_if(quality = 1 AND n_chars > 500) / count_if(n_chars > 500), 6) END AS precision, CASE WHEN count_if(quality = 1) > 0 THEN round(count_if(quality = 1 AND n_chars > 500) / count_if(quality = 1), 6) END AS recall
FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)""")
def q_label_metrics(spark, d):
    """Precision and recall of a rule (long texts are good) against the labels, by source and over all."""
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    said, truth = F.col("n_chars") > 500, F.col("quality") == 1
    m = j.rollup("source").agg(F.count("*").alias("n"), F.count_if(said & truth).alias("hits"), F.count_if(said).alias("said"), F.count_if(truth).alias("truth"))
    share = lambda c: F.when(F.col(c) > 0, F.round(F.col("hits") / F.col(c), 6))
    return m.withColumns({"source": F.coalesce("source", F.lit("all")), "precision": share("said"), "recall": share("truth")})


@query("""WITH g AS (SELECT item_id, part, unnest(CASE WHEN length(t) >= 2 THEN list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) ELSE [] END) AS g
  FROM (SELECT item_id, 'text' AS part, lower(text) AS t FROM benchmark UNION ALL SELECT item_id, 'head', lower(left(text, length(text) // 2)) FROM benchmark)),
v AS (SELECT item_id, part, CAST('0x' || substr(md5(g), 1, 4) AS INTEGER) % 64 AS b, count(*) AS n FROM g GROUP BY ALL), z AS (SELECT item_id, part, sum(n * n) AS q FROM v GROUP BY ALL),
p AS (SELECT a.item_id, sum(a.n * c.n) AS dot FROM v a JOIN v c ON c.item_id = a.item_id AND c.b = a.b AND c.part = 'head' WHERE a.part = 'text' GROUP BY 1)
SELECT p.item_id, round(dot / sqrt(x.q::DOUBLE * y.q::DOUBLE), 6) AS cosine FROM p JOIN z x ON x.item_id = p.item_id AND x.part = 'text' JOIN z y ON y.item_id = p.item_id AND y.part = 'head'""")
def q_hash_embed_cos(spark, d):
    """Texts as 64 counts of hashed character bigrams: the cosine of every item's text with its first half. Of long format, in one shuffle."""
    t = F.lower("text")
    half = F.substr(t, F.lit(1), F.floor(F.length(t) / 2).cast("int"))
    pairs = lambda c: F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))
    both = F.inline(F.array(F.struct(F.lit("text").alias("part"), pairs(t).alias("g")), F.struct(F.lit("head").alias("part"), pairs(half).alias("g"))))
    rows = table(spark, d, "benchmark").select("item_id", both).select("item_id", "part", F.explode("g").alias("g"))
    bucket = F.conv(F.substring(F.md5("g"), 1, 4), 16, 10).cast("int") % 64
    n = lambda p: F.count_if(F.col("part") == p).cast("double").alias(p)
    v = rows.groupBy("item_id", bucket.alias("b")).agg(n("text"), n("head"))
    sums = v.groupBy("item_id").agg(F.sum(F.col("text") * F.col("head")).alias("dot"), F.sum(F.col("text") * F.col("text")).alias("q"), F.sum(F.col("head") * F.col("head")).alias("r"))
    return sums.where("r > 0").select("item_id", F.round(F.col("dot") / F.sqrt(F.col("q") * F.col("r")), 6).alias("cosine"))
