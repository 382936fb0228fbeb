"""Scans, Boolean search, projections and text functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import text as X
from tidewatch.operators import search as S
from tidewatch.sources.tables import DOCS_SQL, FEED_SQL, documents, feed, table

from .catalogue import query

BOOL = (S.term("the") | S.term("ein")) & S.term("on") & ~S.term("la")
BOOL_SQL = "(contains(t, 'the') OR contains(t, 'ein')) AND contains(t, 'on') AND NOT contains(t, 'la')"
_n = lambda t, w: f"((length({t}) - length(replace({t}, '{w}', ''))) // {len(w)})"
SCORE_SQL = " + ".join(_n("t", w) for w in ("the", "ein", "on"))
ALL_SQL = "lower(concat_ws(' ', title, text, source))"
TOKENS_SQL = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '\p{{N}}+'))"


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en'")
def q_scan_documents(spark, d):
    return documents(spark, d).where("lang = 'en'").select("doc_id", "lang", "source")


@query(f"WITH {DOCS_SQL} SELECT doc_id, title, source FROM docs")
def q_projection(spark, d):
    return documents(spark, d).select("doc_id", "title", "source")


@query("SELECT ord, doc_id, source FROM (VALUES (0, 7), (1, 3), (2, 999999999), (3, 11), (4, 0)) v(ord, want) JOIN documents ON doc_id = want")
def q_lookup_by_ids(spark, d):
    wanted = spark.createDataFrame([(0, 7), (1, 3), (2, 999999999), (3, 11), (4, 0)], "ord int, want long")
    docs = documents(spark, d)
    return docs.join(wanted, docs.doc_id == wanted.want).select("ord", "doc_id", "source").orderBy("ord")


@query("SELECT event_id, substr(md5(concat_ws('|', CAST(user_id AS VARCHAR), event_type, props)), 1, 16) AS request_key FROM events")
def q_request_key(spark, d):
    return feed(spark, d).select("event_id", F.substring(F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props")), 1, 16).alias("request_key"))


@query(f"WITH {DOCS_SQL}, t AS (SELECT *, {ALL_SQL} AS t FROM docs) SELECT doc_id, source FROM t WHERE {BOOL_SQL}")
def q_bool_search(spark, d):
    return S.search(documents(spark, d), BOOL).select("doc_id", "source")


@query(f"WITH {DOCS_SQL}, t AS (SELECT *, {ALL_SQL} AS t FROM docs) SELECT doc_id, CAST({SCORE_SQL} AS INTEGER) AS score FROM t WHERE {BOOL_SQL}")
def q_search_score(spark, d):
    return S.search(documents(spark, d), BOOL).select("doc_id", F.col("score").cast("int").alias("score"))


@query(f"WITH {DOCS_SQL}, t AS (SELECT *, {ALL_SQL} AS t FROM docs) SELECT doc_id, CAST({SCORE_SQL} AS INTEGER) AS score FROM t WHERE {BOOL_SQL} ORDER BY score DESC, doc_id LIMIT 50")
def q_search_ranked(spark, d):
    return S.search(documents(spark, d), BOOL).select("doc_id", F.col("score").cast("int").alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query(f"WITH {DOCS_SQL} SELECT count(*) FILTER (contains(lower(title), 'the')) AS in_title, count(*) FILTER (contains(lower(text), 'the')) AS in_content, count(*) FILTER (contains({ALL_SQL}, 'the')) AS anywhere FROM docs")
def q_search_scoped(spark, d):
    n = lambda w: F.count_if(S.matches(S.term("the"), S.scope(w)))
    return documents(spark, d).agg(n("title").alias("in_title"), n("content").alias("in_content"), n("all").alias("anywhere"))


@query(f"WITH {FEED_SQL} SELECT event_id, event_type FROM feed WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND event_type IN ('error', 'purchase') AND starts_with(CAST(user_id AS VARCHAR), '1')")
def q_search_filters(spark, d):
    f = F.col
    return feed(spark, d).where((f("ts") >= F.lit("2024-01-05").cast("timestamp")) & (f("ts") < F.lit("2024-01-12").cast("timestamp")) & f("event_type").isin("error", "purchase") & f("user_id").cast("string").startswith("1")).select("event_id", "event_type")


@query("""WITH h AS (SELECT doc_id, text, instr(lower(text), 'est') AS pos FROM documents), s AS (SELECT *, greatest(pos - 40, 1) AS start FROM h WHERE pos > 0),
r AS (SELECT doc_id, substr(text, start, 200) AS s, pos - start + 1 AS hit FROM s)
SELECT doc_id, substr(s, 1, hit - 1) || '<b>' || substr(s, hit, 3) || '</b>' || substr(s, hit + 3) AS snippet FROM r""")
def q_highlight(spark, d):
    return table(spark, d, "documents").select("doc_id", S.highlight(F.col("text"), "est").alias("snippet")).where("snippet IS NOT NULL")


@query(f"WITH {DOCS_SQL}, t AS (SELECT *, {ALL_SQL} AS t FROM docs), h AS (SELECT doc_id, source FROM t WHERE contains(t, 'on')) SELECT doc_id, source, (SELECT count(*) FROM h) AS total FROM h ORDER BY source, doc_id LIMIT 20 OFFSET 20")
def q_search_paged(spark, d):
    return S.page(S.search(documents(spark, d), S.term("on")).select("doc_id", "source"), [F.col("source"), F.col("doc_id")], 20, 20)


@query("SELECT strftime(ts, '%Y%m%d') AS label, count(*) AS hits FROM events GROUP BY 1")
def q_timeline_day(spark, d):
    return S.histogram(feed(spark, d), F.col("ts"), "day")


@query("SELECT strftime(o_orderdate, '%Y%m') AS label, count(*) AS hits FROM orders GROUP BY 1")
def q_timeline_month(spark, d):
    return S.histogram(table(spark, d, "orders"), F.col("o_orderdate"), "month")


CLOUD_SQL = f"""WITH h AS (SELECT doc_id, list_distinct({TOKENS_SQL.format('text')}) AS ws FROM documents WHERE contains(lower(text), 'est')),
c AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM h) WHERE NOT contains(word, 'est') GROUP BY word),
b AS (SELECT * FROM c ORDER BY n DESC, word LIMIT 30)"""


@query(CLOUD_SQL + " SELECT word, n, CAST(floor(200 * n / (SELECT max(n) FROM b) + 0.5) AS INTEGER) AS weight FROM b")
def q_word_cloud(spark, d):
    return S.co_occurring(table(spark, d, "documents").where(S.matches(S.term("est"), F.col("text"))), X.tokens(F.col("text")), "est")


@query(CLOUD_SQL + " SELECT word, n FROM b WHERE length(word) >= 4 AND NOT regexp_matches(word, '[0-9]') ORDER BY n DESC, word LIMIT 3")
def q_query_expansion(spark, d):
    cloud = S.co_occurring(table(spark, d, "documents").where(S.matches(S.term("est"), F.col("text"))), X.tokens(F.col("text")), "est")
    return cloud.where((F.length("word") >= 4) & ~F.col("word").rlike("[0-9]")).orderBy(F.desc("n"), "word").limit(3).select("word", "n")


STEPS = {"the AND est AND thou": S.term("the") & S.term("est") & S.term("thou"), "the AND est": S.term("the") & S.term("est"), "the": S.term("the")}


@query("""WITH q AS (SELECT lang AS key, ord, query, count(*) FILTER (ok) AS hits FROM (
  SELECT lang, 0 AS ord, 'the AND est AND thou' AS query, contains(t, 'the') AND contains(t, 'est') AND contains(t, 'thou') AS ok FROM (SELECT lang, lower(text) AS t FROM documents)
  UNION ALL SELECT lang, 1, 'the AND est', contains(t, 'the') AND contains(t, 'est') FROM (SELECT lang, lower(text) AS t FROM documents)
  UNION ALL SELECT lang, 2, 'the', contains(t, 'the') FROM (SELECT lang, lower(text) AS t FROM documents)) GROUP BY 1, 2, 3)
SELECT key, arg_min(query, {'a': NOT hits BETWEEN 1 AND 200, 'b': CASE WHEN hits BETWEEN 1 AND 200 THEN ord ELSE hits END, 'c': ord}) AS query FROM q GROUP BY key""")
def q_calibrate(spark, d):
    docs = table(spark, d, "documents")
    counts = docs.groupBy(F.col("lang").alias("key")).agg(*(F.count_if(S.matches(c, F.col("text"))).alias(f"h{i}") for i, c in enumerate(STEPS.values())))
    rows = F.inline(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(s).alias("query"), F.col(f"h{i}").alias("hits")) for i, s in enumerate(STEPS))))
    return S.narrowest(counts.select("key", rows), 200)


@query("SELECT n_nationkey, '(\"' || n_name || '\") AND (\"' || r_name || '\" OR \"relief\")' AS query FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_query_builder(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("")), F.lit('"'))
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.concat(F.lit("("), quoted("n_name"), F.lit(") AND ("), F.array_join(F.array(quoted("r_name"), F.lit('"relief"')), " OR "), F.lit(")")).alias("query"))


@query(f"WITH {DOCS_SQL} SELECT doc_id, CASE WHEN regexp_matches(lower(title), 'the|der|le ') THEN 'plain' WHEN regexp_matches(title, '[0-9]') THEN 'numbered' ELSE 'other' END AS class FROM docs")
def q_title_class(spark, d):
    t = F.col("title")
    return documents(spark, d).select("doc_id", F.when(F.lower(t).rlike("the|der|le "), "plain").when(t.rlike("[0-9]"), "numbered").otherwise("other").alias("class"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'thou|mente|ione') AND NOT regexp_matches(lower(text), 'quela|zwq')")
def q_support_filter(spark, d):
    t = F.lower("text")
    return table(spark, d, "documents").where(t.rlike("thou|mente|ione") & ~t.rlike("quela|zwq")).select("doc_id")


@query(f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct, w[1] AS first FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS w FROM documents)")
def q_tokenize(spark, d):
    w = X.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"), F.get("w", F.lit(0)).alias("first"))


@query(f"WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter({TOKENS_SQL.format('title')}, lambda w: length(w) >= 4 AND w NOT IN ('that', 'than', 'mente')))) AS w FROM (SELECT doc_id, split_part(text, '.', 1) AS title FROM documents)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) AS rn FROM t) SELECT doc_id, string_agg(w, ' ' ORDER BY rn) AS terms FROM r WHERE rn <= 3 GROUP BY doc_id")
def q_action_terms(spark, d):
    w = F.filter(X.distinct_tokens(F.col("title")), lambda x: (F.length(x) >= 4) & ~x.isin("that", "than", "mente"))
    longest = F.array_sort(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w"))))
    return documents(spark, d).select("doc_id", F.array_join(F.transform(F.slice(longest, 1, 3), lambda s: s.w), " ").alias("terms")).where("terms <> ''")


@query(r"SELECT doc_id, CAST(len(f) AS INTEGER) AS n, array_to_string(list_sort(f), ',') AS families FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(lower(text), 'est|thou|mente|tion|sch'), lambda x: CASE x WHEN 'est' THEN 'flood' WHEN 'thou' THEN 'fire' WHEN 'mente' THEN 'storm' WHEN 'tion' THEN 'quake' ELSE 'crowd' END)) AS f FROM documents)")
def q_keyword_families(spark, d):
    names = F.create_map(*(F.lit(x) for kv in {"est": "flood", "thou": "fire", "mente": "storm", "tion": "quake", "sch": "crowd"}.items() for x in kv))
    f = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("est|thou|mente|tion|sch"), 0), lambda x: names[x]))
    return table(spark, d, "documents").select("doc_id", f.alias("f")).select("doc_id", F.size("f").alias("n"), F.array_join(F.array_sort("f"), ",").alias("families"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+'))), '|') AS names FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+ [A-Z][a-z]+')")
def q_entity_extract(spark, d):
    p = "[A-Z][a-z]+ [A-Z][a-z]+"
    return table(spark, d, "documents").where(F.col("text").rlike(p)).select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(p), 0))), "|").alias("names"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '(key|token|password)=[^\s&]+', '\1=***', 'gi'), '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '***', 'g') AS url FROM pages")
def q_mask_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.mask(F.col("url")).alias("url"))


@query(r"SELECT doc_id, CASE WHEN length(c) > 80 THEN substr(c, 1, 79) || '…' ELSE c END AS clean FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') AS c FROM documents)")
def q_clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clip(X.collapse(X.strip_tags(F.col("text"))), 80).alias("clean"))


@query(r"SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest FROM (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.!?\n]+')), ' ') AS s FROM documents) WHERE length(s) >= 4) GROUP BY doc_id")
def q_sentence_split(spark, d):
    s = X.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).where("size(s) > 0").select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"))


@query("SELECT doc_id, substr(text, greatest(1, instr(lower(text), 'tion') - 48), 100) AS span FROM documents WHERE contains(lower(text), 'tion')")
def q_evidence_window(spark, d):
    return table(spark, d, "documents").select("doc_id", X.window_around(F.col("text"), "tion").alias("span")).where("span IS NOT NULL")


@query(r"WITH c AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[,.;\n]+')) AS c FROM conversations), t AS (SELECT conv_id, turn, trim(c, ' ') AS c FROM c) SELECT conv_id, turn, arg_max(c, {'n': length(c), 'c': c}) AS clause FROM t WHERE length(c) BETWEEN 4 AND 40 GROUP BY 1, 2")
def q_action_clause(spark, d):
    parts = F.filter(F.transform(F.split("text", r"[,.;\n]+"), lambda c: F.trim(c)), lambda c: F.length(c).between(4, 40))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(parts).alias("c"))
    return rows.groupBy("conv_id", "turn").agg(F.max_by("c", F.struct(F.length("c"), "c")).alias("clause"))


BIGRAMS_SQL = "CASE WHEN length({0}) >= 2 THEN list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) ELSE [] END"


@query(f"WITH p AS (SELECT doc_id, lower(split_part(text, '.', 1)) AS t, lower(text) AS x FROM documents), g AS (SELECT doc_id, {BIGRAMS_SQL.format('t')} AS a, {BIGRAMS_SQL.format('x')} AS b FROM p) SELECT doc_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS both, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS either FROM g")
def q_bigram_jaccard(spark, d):
    """How much of a document's character pairs its title has: both sets of every document, whole texts."""
    g = documents(spark, d).select("doc_id", X.grams(F.lower("title"), 2).alias("a"), X.grams(F.lower("text"), 2).alias("b"))
    return g.select("doc_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("either"))


@query(r"SELECT doc_id, max(CASE WHEN length(n) <= 9 AND CAST(n AS BIGINT) BETWEEN 1 AND 4999 THEN CAST(n AS INTEGER) END) AS largest FROM (SELECT doc_id, unnest(CASE WHEN regexp_matches(text, '\d') THEN list_transform(regexp_extract_all(text, '\d+'), lambda n: CASE WHEN length(n) <= 9 THEN n ELSE '0' END) ELSE ['0'] END) AS n FROM documents) GROUP BY doc_id")
def q_regex_max_number(spark, d):
    return table(spark, d, "documents").select("doc_id", X.largest_number(F.col("text"), 5000).alias("largest"))


@query(r"SELECT page_id, array_to_string(list_sort(regexp_extract_all(url, '\d+')), ',') = array_to_string(list_sort(regexp_extract_all(html, '\d+')), ',') AS kept FROM pages")
def q_number_guard(spark, d):
    return table(spark, d, "pages").select("page_id", (X.sorted_numbers(F.col("url")) == X.sorted_numbers(F.col("html"))).alias("kept"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) || ',' || CAST(p_size AS VARCHAR) ELSE p_name || '/' || p_type || '/' || p_brand END AS items, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 3 END AS n FROM part")
def q_list_split(spark, d):
    """Lists of names written with | or , and lists of codes, of every part."""
    c, kind = F.col, F.col("p_partkey") % 3
    written = F.when(kind == 0, F.concat_ws(",", c("p_partkey").cast("string"), c("p_size").cast("string"))).when(kind == 1, F.concat_ws("|", "p_name", "p_type", "p_brand")).otherwise(F.concat_ws(",", "p_name", "p_type", "p_brand"))
    return table(spark, d, "part").select("p_partkey", X.listed(written).alias("l")).select("p_partkey", F.array_join("l", "/").alias("items"), F.size("l").alias("n"))


@query("""WITH w AS (SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN ' ' || c_mktsegment WHEN 1 THEN '시' WHEN 2 THEN '군)' ELSE '' END AS w FROM customer), e AS (SELECT *, regexp_replace(w, '[^가-힣0-9A-Za-z]', '', 'g') AS t FROM w)
SELECT c_custkey, w || CASE WHEN right(t, 1) IN ('군', '0', '1', '3', '6', '7', '8', 'l', 'm', 'n', 'r', 'L', 'M', 'N', 'R') THEN '은' ELSE '는' END AS said FROM e""")
def q_particle(spark, d):
    """Names that end with digits, Latin letters or Hangul, with the particle that fits."""
    kind = F.col("c_custkey") % 4
    tail = F.when(kind == 0, F.concat(F.lit(" "), "c_mktsegment")).when(kind == 1, "시").when(kind == 2, "군)").otherwise("")
    return table(spark, d, "customer").select("c_custkey", X.particle(F.concat("c_name", tail), "은", "는").alias("said"))


@query("SELECT doc_id, a || '-' || b AS parts, CAST(doc_id % 24 AS INTEGER) AS hour FROM (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS a, split_part(source, 'c', 2) AS b FROM documents)")
def q_id_parts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws("-", F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.split_part("source", F.lit("c"), F.lit(2))).alias("parts"), (F.col("doc_id") % 24).cast("int").alias("hour"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def q_html_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(r"SELECT page_id, CAST(len(l) AS INTEGER) AS n_links, array_to_string(list_sort(list_distinct(l)), ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href=" + '"([^"]*)"' + r"', 1) AS l FROM pages)")
def q_html_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, d, "pages").select("page_id", links.alias("l")).select("page_id", F.size("l").alias("n_links"), F.array_join(F.array_sort(F.array_distinct("l")), " ").alias("links"))


RULES = [("/", True), ("/fr", False), ("/fr/8", True), ("/de/", False), ("/es/1", False), ("/es/1", True)]


@query(f"""WITH r(p, allow) AS (VALUES {", ".join(f"('{p}', {a})" for p, a in RULES)}), u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, arg_max(allow, struct_pack(n := length(p), a := allow)) AS allowed FROM u JOIN r ON starts_with(path, p) GROUP BY page_id""")
def q_robots_longest_match(spark, d):
    """The rules are a literal list inside the plan, so no join is needed: the longest rule that fits wins, allowing ones at a tie."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)
    fits = F.filter(F.array(*(F.struct(F.lit(len(p)).alias("n"), F.lit(a).alias("allow"), F.lit(p).alias("p")) for p, a in RULES)), lambda r: F.col("path").startswith(r.p))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r.n.alias("n"), r.allow.alias("allow"))))
    return table(spark, d, "pages").select("page_id", path.alias("path")).select("page_id", best.allow.alias("allowed")).where("allowed IS NOT NULL")


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) IN ('http', 'https') AND ends_with(h, '.example.com') AND NOT (h = 'news.example.com' OR ends_with(h, '.news.example.com')) AS ok FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages)")
def q_url_guard(spark, d):
    h = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    ok = F.regexp_extract("url", "^([a-z]+)://", 1).isin("http", "https") & h.endswith(".example.com") & ~((h == "news.example.com") | h.endswith(".news.example.com"))
    return table(spark, d, "pages").select("page_id", ok.alias("ok"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, json_extract_string(props, '$.none') IS NULL AS missing FROM events")
def q_json_props(spark, d):
    parsed = F.from_json("props", "k int, none string", {"mode": "PERMISSIVE"})
    return table(spark, d, "events").select("event_id", F.coalesce(parsed.k, F.lit(0)).alias("k"), parsed.none.isNull().alias("missing"))
