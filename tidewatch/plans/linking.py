"""Joins and linking."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import text as X
from tidewatch.operators import linking as L
from tidewatch.sources.tables import CASES_SQL, DOCS_SQL, FEED_SQL, LINKS_SQL, PROMISES_SQL, cases, documents, feed, links, promises, shared_dir, table

from .catalogue import query
from .search import TOKENS_SQL

KEY = ["case_id", "part", "supp", "line"]
#: The least similarity of a match. The reference has 0.8 for texts; between the table's vectors of a label hardly any is over 0.4.
MATCH_AT = 0.3
WORDS_SQL = f"words AS (SELECT DISTINCT doc_id, unnest({TOKENS_SQL.format('text')}) AS word FROM documents)"
#: Stand-ins: a source's seeds are the words of its first document's title; words of up to three letters are generic.
WEIGHTS_SQL = f"""{WORDS_SQL}, n AS (SELECT count(*) AS n_docs FROM documents), df AS (SELECT word, count(*) AS df FROM words GROUP BY word),
core AS (SELECT source AS key, doc_id FROM documents WHERE source IS NOT NULL), sz AS (SELECT key, count(*) AS n_core FROM core GROUP BY key),
tf AS (SELECT c.key, w.word, count(*) AS n FROM core c JOIN words w ON c.doc_id = w.doc_id GROUP BY 1, 2),
seeds AS (SELECT DISTINCT source AS key, unnest({TOKENS_SQL.format("split_part(text, '.', 1)")}) AS word FROM (SELECT source, arg_min(text, doc_id) AS text FROM documents GROUP BY source)),
raw AS (SELECT key, word, length(word) <= 3 AS generic, s.word IS NOT NULL AS seed, coalesce(n, 0) / n_core * (ln((n_docs + 1) / (coalesce(df, 0) + 1)) / ln(n_docs + 1)) AS raw, ln((n_docs + 1) / (coalesce(df, 0) + 1)) / ln(n_docs + 1) AS idf
  FROM tf FULL JOIN seeds s USING (key, word) JOIN sz USING (key) LEFT JOIN df USING (word), n),
best AS (SELECT key, max(raw) FILTER (NOT generic) AS best FROM raw GROUP BY key),
share AS (SELECT raw.*, least(1.0, raw / coalesce(nullif(best, 0), 1)) AS s FROM raw JOIN best USING (key)),
wt AS (SELECT key, word, CASE WHEN generic THEN least(s, 0.05) WHEN seed AND idf >= 0.45 THEN greatest(s, 0.6) ELSE s END AS w FROM share),
weights AS (SELECT key, word, floor(1000 * w + 0.5) / 1000 AS weight, row_number() OVER (PARTITION BY key ORDER BY floor(1000 * w + 0.5) / 1000 DESC, word) AS rn FROM wt WHERE w >= 0.05)"""


def checkpoints(spark) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


@contextlib.contextmanager
def small_splits(spark, size: str = "16m"):
    """Scans that run inside read ``size`` a task, so that what a task adds up in memory doesn't grow with the table."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.distinct_tokens(F.col("text"))).alias("word"))


def n_docs(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n_docs"))


def split(spark, d):
    """key, doc_id, word of all documents, split once and written; null keys too."""
    path = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    table(spark, d, "documents").select(F.col("source").alias("key"), "doc_id", F.explode(X.distinct_tokens(F.col("text"))).alias("word")).write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.parquet(path)


def weights(spark, d, words=None, top=40):
    """Word weights of the sources, ``top`` of each (None: all). Every document has one source, so the words' document frequencies are sums of the sources' counts."""
    docs = table(spark, d, "documents").select(F.col("source").alias("key"), "doc_id", "text")
    words = docs.select("key", F.explode(X.distinct_tokens(F.col("text"))).alias("word")) if words is None else words
    counts = words.groupBy("key", "word").agg(F.count("*").alias("n"))
    checkpoints(spark)
    with small_splits(spark):
        counts = counts.checkpoint()  # texts are split once; all that follows reads the counts
    sizes = docs.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n_core"))
    first = docs.groupBy("key").agg(F.min_by("text", "doc_id").alias("text"))
    seeds = first.select("key", F.explode(X.distinct_tokens(F.substring_index("text", ".", 1))).alias("word"))
    seeds, n = seeds.checkpoint(), n_docs(spark, d).checkpoint()
    counts, sizes, df = L.heavy_words(counts, sizes, n, seeds, F.length("word") <= 3)
    return L.term_weights(counts, sizes, df, n, seeds, F.length("word") <= 3, top)


@query(f"WITH {LINKS_SQL}, {CASES_SQL} SELECT l.case_id, l.part, l.supp, l.line, c.region FROM links l JOIN cases c ON l.case_id = c.case_id WHERE l.active")
def q_join_inner(spark, d):
    return links(spark, d).where("active").join(cases(spark, d), "case_id").select(*KEY, "region")


@query(f"WITH {PROMISES_SQL} SELECT p.case_id, p.part, p.supp, s_name, c.org FROM promises p JOIN supplier ON p.supp = s_suppkey JOIN cases c ON p.case_id = c.case_id")
def q_join_three_way(spark, d):
    p, s = promises(spark, d), table(spark, d, "supplier")
    return p.join(s, p.supp == s.s_suppkey).join(cases(spark, d), "case_id").select("case_id", "part", "supp", "s_name", "org")


@query(f"WITH {LINKS_SQL}, {CASES_SQL} SELECT case_id, region FROM cases c WHERE EXISTS (SELECT 1 FROM links l WHERE l.case_id = c.case_id AND l.active AND l.signal = 'problem')")
def q_join_semi(spark, d):
    return cases(spark, d).join(links(spark, d).where("active AND signal = 'problem'"), "case_id", "left_semi").select("case_id", "region")


@query(f"WITH {LINKS_SQL}, {CASES_SQL} SELECT case_id FROM cases c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.case_id = c.case_id AND l.active)")
def q_join_anti(spark, d):
    return cases(spark, d).join(links(spark, d).where("active"), "case_id", "left_anti").select("case_id")


@query(f"WITH {PROMISES_SQL} SELECT c.case_id, p.action FROM cases c LEFT JOIN promises p ON c.case_id = p.case_id")
def q_join_left(spark, d):
    return cases(spark, d).join(promises(spark, d).select("case_id", "action"), "case_id", "left").select("case_id", "action")


@query(f"WITH {LINKS_SQL} SELECT case_id, part FROM links WHERE active UNION SELECT case_id, part FROM links WHERE signal = 'done'")
def q_candidate_union(spark, d):
    k = links(spark, d)
    return k.where("active").select("case_id", "part").union(k.where("signal = 'done'").select("case_id", "part")).distinct()


@query(f"WITH {LINKS_SQL} SELECT case_id, part FROM links WHERE review UNION SELECT case_id, part FROM links WHERE rejected")
def q_set_union_distinct(spark, d):
    k = links(spark, d)
    return k.where("review").select("case_id", "part").union(k.where("rejected").select("case_id", "part")).distinct()


@query(f"WITH {LINKS_SQL} SELECT case_id FROM links WHERE signal = 'done' INTERSECT SELECT case_id FROM links WHERE signal = 'problem'")
def q_set_intersect(spark, d):
    k = links(spark, d)
    return k.where("signal = 'done'").select("case_id").intersect(k.where("signal = 'problem'").select("case_id"))


@query(f"WITH {LINKS_SQL} SELECT case_id FROM links WHERE active EXCEPT SELECT case_id FROM links WHERE review")
def q_set_except(spark, d):
    k = links(spark, d)
    return k.where("active").select("case_id").subtract(k.where("review").select("case_id"))


@query(f"WITH {LINKS_SQL}, a AS (SELECT case_id, coalesce(list_distinct(list(part) FILTER (active)), []) AS x, coalesce(list_distinct(list(part) FILTER (matches)), []) AS y FROM links GROUP BY 1) SELECT case_id, CAST(len(list_intersect(x, y)) AS INTEGER) AS n_both, CAST(len(list_distinct(list_concat(x, y))) AS INTEGER) AS n_either, len(list_intersect(x, y)) > 0 AS meet FROM a")
def q_array_sets(spark, d):
    a = links(spark, d).groupBy("case_id").agg(F.collect_set(F.when(F.col("active"), F.col("part"))).alias("x"), F.collect_set(F.when(F.col("matches"), F.col("part"))).alias("y"))
    return a.select("case_id", F.size(F.array_intersect("x", "y")).alias("n_both"), F.size(F.array_union("x", "y")).alias("n_either"), F.arrays_overlap("x", "y").alias("meet"))


@query(f"WITH {WORDS_SQL} SELECT word, count(*) AS df FROM words GROUP BY word")
def q_doc_freq(spark, d):
    return L.document_frequency(words(spark, d))


@query(f"WITH {WORDS_SQL}, n AS (SELECT count(*) AS n FROM documents) SELECT word, CAST(floor(1000 * (ln((n + 1) / (df + 1)) / ln(n + 1)) + 0.5) AS INTEGER) AS idf FROM (SELECT word, count(*) AS df FROM words GROUP BY word), n")
def q_idf(spark, d):
    return L.document_frequency(words(spark, d)).crossJoin(n_docs(spark, d)).select("word", F.floor(1000 * L.idf(F.col("df"), F.col("n_docs")) + 0.5).cast("int").alias("idf"))


@query(f"WITH {WEIGHTS_SQL} SELECT key, word, CAST(round(weight * 1000) AS INTEGER) AS weight FROM weights WHERE rn <= 40")
def q_term_weights(spark, d):
    return weights(spark, d).select("key", "word", F.round(F.col("weight") * 1000).cast("int").alias("weight"))


@query(f"WITH {WEIGHTS_SQL} SELECT key, string_agg(word || ':' || CAST(CAST(round(weight * 1000) AS INTEGER) AS VARCHAR), ' ' ORDER BY rn) AS top FROM weights WHERE rn <= 5 GROUP BY key")
def q_map_topk(spark, d):
    best = weights(spark, d).where("rn <= 5").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rn", "word", F.round(F.col("weight") * 1000).cast("int").alias("w")))).alias("t"))
    return best.select("key", F.array_join(F.transform("t", lambda s: F.concat_ws(":", s.word, s.w.cast("string"))), " ").alias("top"))


@query(f"""WITH {WEIGHTS_SQL}, k AS (SELECT key, word, CAST(round(weight * 1000) AS BIGINT) AS w, rn FROM weights WHERE rn <= 40), b AS (SELECT key, CAST(sum(w) AS BIGINT) AS top10 FROM k WHERE rn <= 10 GROUP BY key)
SELECT k.key, count(DISTINCT doc_id) AS n_docs, CAST(sum(w) AS BIGINT) AS hits, max(top10) AS top10 FROM k JOIN words ON k.word = words.word JOIN b ON k.key = b.key GROUP BY k.key""")
def q_weighted_overlap(spark, d):
    own = split(spark, d)
    w = weights(spark, d, own).select("key", "word", F.round(F.col("weight") * 1000).cast("long").alias("w"), "rn").checkpoint()
    best = w.where("rn <= 10").groupBy("key").agg(F.sum("w").alias("top10"))
    per_doc = own.select("doc_id", "word").join(L.small(w), "word").groupBy("key", "doc_id").agg(F.sum("w").alias("w"))
    return per_doc.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("w").alias("hits")).join(best, "key").select("key", "n_docs", "hits", "top10")


@query(f"WITH {WEIGHTS_SQL} SELECT key, doc_id, CAST(least(1000, 1000 * max(w) + 500 * (sum(w) - max(w))) AS INTEGER) AS sentence FROM (SELECT k.key, words.doc_id, CAST(round(weight * 1000) AS BIGINT) / 1000.0 AS w FROM weights k JOIN words ON k.word = words.word) GROUP BY 1, 2 HAVING max(w) > 0.9")
def q_sentence_weight(spark, d):
    """The largest weight and half of all the rest, 1 at most, in thousandths."""
    own = split(spark, d)
    w = weights(spark, d, own, None).select("key", "word", F.round(F.col("weight") * 1000).cast("long").alias("w")).checkpoint()
    return L.sentence_weights(w, own)


@query(f"WITH {DOCS_SQL}, t AS (SELECT source, doc_id, unnest(list_distinct({TOKENS_SQL.format('title')})) AS word FROM docs) SELECT source, word, count(DISTINCT doc_id) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2")
def q_specific_terms(spark, d):
    t = documents(spark, d).select("source", "doc_id", F.explode(X.distinct_tokens(F.col("title"))).alias("word"))
    return t.groupBy("source", "word").agg(F.count_distinct("doc_id").alias("n")).where("n >= 2")


GATE_SQL = f"""{WORDS_SQL}, iw AS (SELECT DISTINCT item_id, unnest({TOKENS_SQL.format('text')}) AS word FROM benchmark),
o AS (SELECT item_id, doc_id, count(*) AS n, count(*) FILTER (length(iw.word) >= 7) AS n_long FROM iw JOIN words ON iw.word = words.word GROUP BY 1, 2)"""


def overlaps(spark, d, least, bonus=0):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), X.distinct_tokens(F.col("text")).alias("words"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), X.distinct_tokens(F.col("text")).alias("words"))
    return L.sharing(items, docs, least, 7, bonus).withColumnsRenamed({"item": "item_id", "doc": "doc_id"})


@query(f"WITH {GATE_SQL} SELECT item_id, doc_id, concat_ws('+', CASE WHEN n >= 8 THEN 'topic' END, CASE WHEN n_long >= 3 THEN 'specific' END, CASE WHEN n >= 15 THEN 'strong' END) AS reason FROM o WHERE n >= 8 AND n_long >= 1")
def q_link_gate(spark, d):
    n, k = F.col("n"), F.col("n_long")
    reasons = F.array_compact(F.array(F.when(n >= 8, F.lit("topic")), F.when(k >= 3, F.lit("specific")), F.when(n >= 15, F.lit("strong"))))
    return overlaps(spark, d, 8).where("n >= 8 AND n_long >= 1").select("item_id", "doc_id", F.array_join(reasons, "+").alias("reason"))


PIPE_SQL = """p AS (SELECT item_id, doc_id, least(100, 4 * n) AS ov, least(100, 20 * n_long) AS sim FROM o WHERE n >= 4),
s AS (SELECT *, (ov + sim) // 2 AS score, n_strong FROM (SELECT p.*, ov >= 60 AS n_strong FROM p)),
k AS (SELECT *, CASE WHEN NOT n_strong AND ov < 15 THEN 'drop' WHEN n_strong OR score >= 55 THEN 'link' WHEN score >= 40 THEN 'review' ELSE 'drop' END AS decision FROM s)"""


@query(f"WITH {GATE_SQL}, {PIPE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rn FROM k WHERE decision <> 'drop') SELECT item_id, doc_id, CAST(score AS INTEGER) AS score, CASE WHEN rn > 1 THEN 'review' ELSE decision END AS decision FROM r")
def q_link_pipeline(spark, d):
    """Gate, score, decide, and one case for each article: a single plan over all items.

    A pair that isn't dropped has 15 shared words, or a score of 40 and so 4 n + 20 n_long >= 80; both mean n + 5 n_long >= 15.
    """
    p = overlaps(spark, d, 15, 5).where("n >= 4").select("item_id", "doc_id", F.least(F.lit(100), 4 * F.col("n")).alias("ov"), F.least(F.lit(100), 20 * F.col("n_long")).alias("sim"))
    p = p.withColumn("score", F.floor((F.col("ov") + F.col("sim")) / 2).cast("int"))
    kept = p.withColumn("decision", L.decide(F.col("score"), F.col("ov"), F.col("ov") >= 60, F.lit(False))).where("decision <> 'drop'")
    won = L.exclusive(kept, "doc_id", F.col("score"), ["item_id"])
    return won.select("item_id", "doc_id", "score", F.when(F.col("winner"), F.col("decision")).otherwise("review").alias("decision"))


@query("WITH t AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}'))) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(split_part(text, '.', 1)), '[a-z]{7,}')) AS w FROM documents) SELECT item_id, doc_id, CAST(least(100, 30 * count(*)) AS INTEGER) AS score FROM t JOIN d ON t.w = d.w GROUP BY 1, 2 HAVING count(*) >= 2")
def q_title_match_score(spark, d):
    w = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{7,}"), 0))).alias("w")
    items, docs = table(spark, d, "benchmark").select("item_id", w("text")), documents(spark, d).select("doc_id", w("title"))
    return items.join(docs, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("n")).where("n >= 2").select("item_id", "doc_id", F.least(F.lit(100), 30 * F.col("n")).cast("int").alias("score"))


@query(f"""WITH {LINKS_SQL}, {CASES_SQL} SELECT l.case_id, part, supp, line, concat_ws('+', CASE WHEN date_diff('day', occurred, pub) > 90 THEN 'x-late' END, CASE WHEN s_nationkey % 5 <> wide THEN 'x-region' END,
CASE WHEN signal = 'problem' AND conf >= 80 THEN 'cap-new' END) AS reason FROM links l JOIN cases c ON l.case_id = c.case_id JOIN supplier s ON l.supp = s.s_suppkey""")
def q_scope_checks(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"), "s_nationkey")
    joined = links(spark, d).join(cases(spark, d), "case_id").join(s, "supp")
    reasons = F.array_compact(F.array(F.when(F.datediff("pub", "occurred") > 90, F.lit("x-late")), F.when(F.col("s_nationkey") % 5 != F.col("wide"), F.lit("x-region")), F.when((F.col("signal") == "problem") & (F.col("conf") >= 80), F.lit("cap-new"))))
    return joined.select(*KEY, F.array_join(reasons, "+").alias("reason"))


BLEND_SQL = "(conf + CAST(round(l_quantity) AS INTEGER) * 2) // 2"


@query("WITH s AS (SELECT l_orderkey AS case_id, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, 50 + 5 * CAST(round(l_discount * 100) AS INTEGER) AS conf, CAST(round(l_quantity) AS INTEGER) AS q FROM lineitem) SELECT case_id, part, supp, line, CAST((conf + 2 * q) // 2 AS INTEGER) AS blend FROM s")
def q_blend_score(spark, d):
    return scored(spark, d).select(*KEY, "blend")


def scored(spark, d):
    q = F.round("l_quantity").cast("int")
    conf = 50 + 5 * F.round(F.col("l_discount") * 100).cast("int")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"),
        conf.alias("conf"), q.alias("q"), F.floor((conf + 2 * q) / 2).cast("int").alias("blend"), F.col("l_returnflag").alias("flag"), (F.col("l_tax") > 0.06).alias("review"))


SCORED_SQL = "s AS (SELECT l_orderkey AS case_id, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, 50 + 5 * CAST(round(l_discount * 100) AS INTEGER) AS conf, CAST(round(l_quantity) AS INTEGER) AS q, l_returnflag AS flag, l_tax > 0.06 AS review FROM lineitem)"


@query(f"WITH {SCORED_SQL}, b AS (SELECT *, (conf + 2 * q) // 2 AS score, q * 2 AS ov, conf >= 95 AS strong FROM s) SELECT case_id, part, supp, line, CASE WHEN NOT (strong AND ov >= 25) AND ov < 15 THEN 'drop' WHEN review THEN CASE WHEN score < 40 THEN 'drop' ELSE 'review' END WHEN strong AND ov >= 25 OR score >= 55 THEN 'link' WHEN score >= 40 THEN 'review' ELSE 'drop' END AS decision FROM b")
def q_link_decide(spark, d):
    decision = L.decide(F.col("blend"), F.col("q") * 2, F.col("conf") >= 95, F.col("review"))
    return scored(spark, d).select(*KEY, decision.alias("decision"))


@query(f"WITH {SCORED_SQL} SELECT case_id, part, supp, line, CASE WHEN p >= 50 THEN 'link' WHEN flag = 'R' THEN CASE WHEN p >= 10 OR review THEN 'link' ELSE 'review' END WHEN p >= 20 THEN 'review' ELSE 'drop' END AS decision FROM (SELECT *, q * 2 - 10 AS p FROM s)")
def q_rerank_decision(spark, d):
    return scored(spark, d).select(*KEY, L.rerank(F.col("q") * 2 - 10, F.col("flag") == "R", F.col("review")).alias("decision"))


@query(f"WITH {LINKS_SQL}, r AS (SELECT *, min((NOT confirmed, -conf, case_id, supp, line)) FILTER (NOT confirmed) OVER (PARTITION BY part) AS best FROM (SELECT *, signal = 'problem' AND conf = 100 AS confirmed FROM links WHERE active)) SELECT case_id, part, supp, line, confirmed OR (NOT confirmed, -conf, case_id, supp, line) = best AS winner FROM r")
def q_multi_event_exclusive(spark, d):
    """Confirmed links (stood for by problems at the highest confidence) keep their place and take nobody else's."""
    confirmed = (F.col("signal") == "problem") & (F.col("conf") == 100)
    return L.exclusive(links(spark, d).where("active"), "part", F.col("conf"), ["case_id", "supp", "line"], exempt=confirmed).select(*KEY, "winner")


@query(f"WITH {FEED_SQL}, p AS (SELECT user_id, CAST(ts AS DATE) AS d, event_id FROM feed WHERE event_type = 'error') SELECT a.user_id, count(*) AS pairs FROM p a JOIN p b ON a.user_id = b.user_id AND abs(date_diff('day', a.d, b.d)) <= 3 AND a.event_id < b.event_id GROUP BY 1")
def q_band_self_join(spark, d):
    e = feed(spark, d).where("event_type = 'error'").select("user_id", F.to_date("ts").alias("day"), "event_id")
    left, right = e.withColumnsRenamed({"day": "l_day", "event_id": "l_id"}), e.withColumnsRenamed({"day": "r_day", "event_id": "r_id"})
    return L.band_pairs(left, right, ["user_id"], 3).where("l_id < r_id").groupBy("user_id").agg(F.count("*").alias("pairs"))


@query(f"WITH {FEED_SQL} SELECT e.event_id, min(struct_pack(ts := p.ts, id := p.event_id)).id AS first_purchase FROM feed e JOIN feed p ON e.user_id = p.user_id AND p.event_type = 'purchase' AND p.ts >= e.ts AND date_diff('day', CAST(e.ts AS DATE), CAST(p.ts AS DATE)) <= 14 WHERE e.event_type = 'error' GROUP BY 1")
def q_first_match_join(spark, d):
    f = feed(spark, d)
    e = f.where("event_type = 'error'").select("user_id", F.to_date("ts").alias("l_day"), F.col("ts").alias("l_ts"), F.col("event_id"))
    p = f.where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("r_day"), F.col("ts").alias("r_ts"), F.col("event_id").alias("r_id"))
    near = L.band_pairs(e, p, ["user_id"], 14).where("r_ts >= l_ts")
    return near.groupBy("event_id").agg(F.min_by("r_id", F.struct("r_ts", "r_id")).alias("first_purchase"))


@query(f"WITH {FEED_SQL} SELECT s.event_id, (SELECT min(p.ts) FROM feed p WHERE p.user_id = s.user_id AND p.event_type = 'purchase' AND p.ts >= s.ts) AS next_ts FROM feed s WHERE s.event_type = 'signup'")
def q_asof_forward(spark, d):
    """The next purchase at or after each signup: one window over both kinds of rows, no join."""
    f = feed(spark, d).where("event_type IN ('signup', 'purchase')")
    later = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return f.withColumn("next_ts", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(later)).where("event_type = 'signup'").select("event_id", "next_ts")


@query(f"WITH {FEED_SQL} SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, max(ts) AS ts FROM feed GROUP BY user_id")
def q_latest_per_key(spark, d):
    return feed(spark, d).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query(f"WITH {CASES_SQL} SELECT customer, count(*) FILTER (itype = '1-URGENT') AS urgent, count(*) AS n FROM cases GROUP BY customer HAVING 10 * count(*) FILTER (itype = '1-URGENT') >= 3 * count(*)")
def q_ratio_having(spark, d):
    return cases(spark, d).groupBy("customer").agg(F.count_if(F.col("itype") == "1-URGENT").alias("urgent"), F.count("*").alias("n")).where("10 * urgent >= 3 * n")


@query("WITH a(alias, name) AS (VALUES ('HOUSEHOLD', 'home office'), ('MACHINERY', 'works office')) SELECT c_custkey, coalesce(a.name, lower(regexp_replace(c_mktsegment, '(ITURE|MOBILE)$', ''))) AS org FROM customer LEFT JOIN a ON c_mktsegment = a.alias")
def q_canonical_org(spark, d):
    alias = spark.createDataFrame([("HOUSEHOLD", "home office"), ("MACHINERY", "works office")], "alias string, name string")
    c = table(spark, d, "customer")
    return c.join(alias, F.col("c_mktsegment") == F.col("alias"), "left").select("c_custkey", F.coalesce("name", F.lower(F.regexp_replace("c_mktsegment", "(ITURE|MOBILE)$", ""))).alias("org"))


@query("WITH f AS (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS w FROM benchmark WHERE length(split_part(text, ' ', 1)) >= 4), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents) SELECT doc_id, count(*) AS n FROM d JOIN f ON d.w = f.w GROUP BY doc_id")
def q_other_facility(spark, d):
    first = F.split_part("text", F.lit(" "), F.lit(1))
    names = table(spark, d, "benchmark").where(F.length(first) >= 4).select(F.lower(first).alias("w")).distinct()
    own = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))).alias("w"))
    return own.join(names, "w").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT p_partkey, lower(replace(p_name, ' ', '')) AS a, lower(replace(p_type, ' ', '')) AS b FROM part) SELECT p_partkey, contains(a, 'ring') OR contains('hotwidgetring', a) AS hit, contains(b, a) OR contains(a, b) AS mutual FROM p")
def q_facility_hit(spark, d):
    a, b = X.bare(F.col("p_name")), X.bare(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", (a.contains("ring") | F.lit("hotwidgetring").contains(a)).alias("hit"), (b.contains(a) | a.contains(b)).alias("mutual"))


@query("SELECT n_nationkey, n_name, r_name AS parent, n_name || '|' || r_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_hierarchy_lookup(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", F.col("r_name").alias("parent"), F.concat_ws("|", "n_name", "r_name").alias("path"))


@query("WITH e(k, site) AS (VALUES (1, 'board-1'), (2, 'board-2')), w(r, site) AS (VALUES (0, 'wide-0'), (3, 'wide-3')) SELECT s_suppkey, coalesce(e.site, w.site, 'none') AS site FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN e ON e.k = s_nationkey LEFT JOIN w ON w.r = n_regionkey")
def q_lookup_with_fallback(spark, d):
    exact = spark.createDataFrame([(1, "board-1"), (2, "board-2")], "k int, own string")
    wide = spark.createDataFrame([(0, "wide-0"), (3, "wide-3")], "r int, up string")
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(exact, F.col("s_nationkey") == F.col("k"), "left").join(wide, F.col("n_regionkey") == F.col("r"), "left")
    return joined.select("s_suppkey", F.coalesce("own", "up", F.lit("none")).alias("site"))


@query("""WITH s AS (SELECT label, arg_min(embedding, vec_id) AS seed, min(vec_id) AS seed_id FROM embeddings GROUP BY label),
c AS (SELECT v.vec_id, v.label, list_sum(list_transform(range(1, 65), lambda i: CAST(v.embedding[i] AS DOUBLE) * s.seed[i])) AS c FROM embeddings v JOIN s ON v.label = s.label WHERE v.vec_id <> s.seed_id)
SELECT label, count(*) FILTER (c >= 0.55) AS link, count(*) FILTER (c >= 0.4 AND c < 0.55) AS review, count(*) FILTER (c < 0.4) AS dropped FROM c GROUP BY label""")
def q_cosine_link(spark, d):
    v = table(spark, d, "embeddings")
    seeds = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("seed"), F.min("vec_id").alias("seed_id"))
    c = v.join(seeds, "label").where("vec_id <> seed_id").select("label", L.dot(F.col("embedding"), F.col("seed")).alias("c"))
    return c.groupBy("label").agg(F.count_if(F.col("c") >= 0.55).alias("link"), F.count_if((F.col("c") >= 0.4) & (F.col("c") < 0.55)).alias("review"), F.count_if(F.col("c") < 0.4).alias("dropped"))


@query(name="q_greedy_match")
def q_greedy_match(spark, d):
    """Even against odd vectors of a label, one to one, at ``MATCH_AT`` or more."""
    checkpoints(spark)
    v = table(spark, d, "embeddings").withColumnRenamed("label", "key")
    even, odd = v.where("vec_id % 2 = 0"), v.where("vec_id % 2 <> 0")
    return L.greedy_match(even.select("key", F.col("vec_id").alias("a"), F.col("embedding").alias("x")), odd.select("key", F.col("vec_id").alias("b"), F.col("embedding").alias("y")), MATCH_AT)


@query(f"""WITH {DOCS_SQL}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.title AS t, b.title AS o, greatest(length(a.title), length(b.title)) AS n FROM docs a JOIN docs b ON a.source = b.source AND a.doc_id < b.doc_id)
SELECT a, b FROM p WHERE 10 * CASE WHEN 10 * abs(length(t) - length(o)) <= n THEN levenshtein(t, o) ELSE n END <= n""")
def q_near_dup(spark, d):
    """Titles of one source that differ in a tenth of their characters at most."""
    t = documents(spark, d).select("doc_id", F.col("source").alias("key"), F.col("title").alias("t"))
    near = L.near_texts(t.where("key IS NOT NULL AND t IS NOT NULL").select("key", "t").distinct())
    near = near.unionAll(near.select("key", F.col("o").alias("t"), F.col("t").alias("o")))
    o = t.select("key", F.col("doc_id").alias("o_id"), F.col("t").alias("o"))
    copies = t.join(o.withColumnRenamed("o", "t"), ["key", "t"]).where("doc_id < o_id").select("doc_id", "o_id")
    others = t.join(near, ["key", "t"]).join(o, ["key", "o"]).where("doc_id < o_id").select("doc_id", "o_id")
    return copies.unionAll(others).select(F.col("doc_id").alias("a"), F.col("o_id").alias("b"))


@query("""WITH g AS (SELECT event_id, user_id, event_type, ts, sum(brk) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), ts) <= 43200 THEN 0 ELSE 1 END AS brk FROM events))
SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id, event_type, g) AS component FROM g QUALIFY count(*) OVER (PARTITION BY user_id, event_type, g) > 1""")
def q_components(spark, d):
    """Chains of one user's events of a type with at most half a day between neighbours, as components of their links."""
    checkpoints(spark)
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    # full seconds of the clock, as SQL's date_diff counts them: a gap of half a day and a fraction may be one second more
    clock = F.timestamp_diff("SECOND", F.lit("0001-01-01").cast("timestamp_ntz"), F.col("ts"))
    after = feed(spark, d).select(F.col("event_id").alias("u"), F.lead("event_id").over(w).alias("v"), (F.lead(clock).over(w) - clock).alias("gap"))
    return L.components(after.where("gap <= 43200").select("u", "v"))


@query(f"WITH {CASES_SQL} SELECT region, arg_min(case_id, struct_pack(d := occurred, i := case_id)) AS case_id FROM cases GROUP BY region")
def q_representative(spark, d):
    return cases(spark, d).groupBy("region").agg(F.min_by("case_id", F.struct("occurred", "case_id")).alias("case_id"))


@query(f"WITH {LINKS_SQL} SELECT case_id, part, min(CASE WHEN signal = 'done' THEN 0 WHEN signal = 'progress' THEN 1 ELSE 2 END) AS source FROM links GROUP BY 1, 2")
def q_candidate_precedence(spark, d):
    rank = F.when(F.col("signal") == "done", 0).when(F.col("signal") == "progress", 1).otherwise(2)
    return links(spark, d).groupBy("case_id", "part").agg(F.min(rank).alias("source"))
