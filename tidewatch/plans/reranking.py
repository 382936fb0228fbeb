"""Features of pairs of source and document, and classifiers over them that haven't seen a document's group."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import text as X
from tidewatch.operators import rerank as R
from tidewatch.operators.linking import small
from tidewatch.sources.tables import table, title

from .catalogue import query
from .linking import WEIGHTS_SQL, checkpoints, weights

#: Stand-ins for the expressions that a user brings.
RULES = {"new_incident": "the", "frame": "der|die", "action": "ing", "policy": "tion", "nationwide": "all", "weather": "ain", "politics": "keit", "quote": "[\"']", "natural": "^e", "traffic": "^f"}
#: Sources with their words (some 3 KB each) up to which they are broadcast.
MOST_CASES = 5_000
SPECIFIC, INCIDENT = "^.{7,}$", ["the", "und", "que"]

PAIR_SQL = f"""{WEIGHTS_SQL}, k AS (SELECT key, word, weight, rn FROM weights WHERE rn <= 40),
c AS (SELECT key, list(word) AS ws, list({{'t': word, 'w': weight}}) AS weights, list(word) FILTER (weight >= 0.6) AS uniq, list(word) FILTER (rn <= 3) AS fac, list(word) FILTER (rn BETWEEN 4 AND 8) AS vows FROM k GROUP BY key),
p AS (SELECT d.*, c.*, split_part(text, '.', 1) AS title, split_part(text, '.', 2) AS head, lang || ' ' || source AS words,
  split_part(text, '.', 1) || ' ' || split_part(text, '.', 2) AS near, split_part(text, '.', 1) || ' ' || split_part(text, '.', 2) || ' ' || lang || ' ' || source AS allt, n_chars - 500 AS days,
  list_sum(list_transform(list_sort(list_transform(weights, lambda x: x.w), 'DESC')[1:10], lambda w: w)) AS ten FROM documents d JOIN c ON d.source = c.key)"""


def _n(terms: str, text: str) -> str:
    return f"len(list_filter(coalesce({terms}, []), lambda t: contains({text}, t)))"


def _part(text: str) -> str:
    return f"least(1.0, coalesce(list_sum(list_transform(list_filter(weights, lambda x: contains({text}, x.t)), lambda x: x.w)), 0) / ten)"


_log = lambda x: f"sign({x}) * ln(1 + abs({x}))"
_hit = lambda p: f"regexp_matches(title, '{p}')"
_rival = "list_filter(CASE WHEN contains(text, 'mente') THEN [] ELSE ['other', 'mentiona'] END, lambda f: contains(text, f))"
_words = "list_distinct(list_filter(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '\\p{N}+')))"
FEATURE_SQL = {
    "cos": "n_chars % 10 / 10", "overlap": _part("text"), "strong": "n_chars > 1000", "other_hit": "contains(text, 'other')", "other_fac_specific": f"len(list_filter({_rival}, lambda f: length(f) >= 7)) > 0", "other_fac_generic": f"len(list_filter({_rival}, lambda f: length(f) < 7)) > 0",
    "promise_cand": "n_chars % 2 = 1", "g_region": "lang = 'en'", "g_facility": "contains(text, 'mente')", "g_facility_title": "false", "g_org": "false", "g_incident": "false", "g_seed_kw": "false", "g_kw": "n_chars % 5", "g_promise_kw": "false",
    "cap_recur": "n_chars % 3 = 0", "cap_place": "n_chars % 4 = 0", "days_log": _log("days"), "late": "days > 14", "days_after_end_log": _log("(days - 14)"), "src_days_log": "0",
    "t_overlap": _part("title"), "h_overlap": _part("head"), "k_overlap": _part("words"), "t_uniq_n": _n("uniq", "title"), "th_uniq_n": _n("uniq", "near"),
    "t_uniq_max": "coalesce(list_max(list_transform(list_filter(weights, lambda x: x.w >= 0.6 AND contains(title, x.t)), lambda x: x.w)), 0)", "t_weight_max": "coalesce(list_max(list_transform(list_filter(weights, lambda x: contains(title, x.t)), lambda x: x.w)), 0)", "n_hit_terms": _n("ws", "allt"),
    "t_region": "contains(title, lang)", "h_region": "contains(allt, lang)", "t_fac": _n("fac", "title") + " > 0", "h_fac": _n("fac", "allt") + " > 0", "t_allowed_region": "contains(title, 'en') OR contains(title, 'fr')", "t_other_region": "contains(title, 'de')",
    **{"t_" + k: _hit(RULES[k]) for k in R.TITLE_RULES}, "t_incident_word": " + ".join(f"contains(title, '{w}')::INT" for w in INCIDENT), "t_event_incident": "contains(title, 'the')", "t_len": "length(title)", "t_ntok": f"len({_words})", "t_quote": "regexp_matches(title, '[\"'']')",
    "wide": "lang = 'fr'", "ev_natural": "lang = 'en' OR lang = 'es'", "ev_traffic": "lang = 'fr'", "ev_cands_log": "ln(1 + len(ws))", "t_promise_hits": _n("vows", "title"), "head_promise_hits": _n("vows", "allt"),
}


def pairs(spark, d):
    """Every document with its source, as article and case; the columns that ``rerank.pair_features`` takes."""
    checkpoints(spark)
    w = weights(spark, d).checkpoint()  # at most forty rows for each source
    of = lambda cond: F.collect_list(F.when(cond, F.col("word")))
    case = w.groupBy(F.col("key").alias("source")).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("weights"), of(F.col("weight") >= 0.6).alias("unique"), of(F.col("rn") <= 3).alias("facility_terms"), of(F.col("rn").between(4, 8)).alias("promise_terms"), F.count("*").alias("n_candidates"))
    c, n = F.col, F.col("n_chars")
    names = lambda *xs: F.array(*(F.lit(x) for x in xs))
    reasons = F.array_compact(F.array(F.when(c("lang") == "en", "region"), F.when(c("text").contains("mente"), "facility"), F.concat(F.lit("kw="), (n % 5).cast("string")), F.when(n % 3 == 0, "cap-recur"), F.when(n % 4 == 0, "cap-place:x")))
    docs = table(spark, d, "documents").withColumn("title", title()).join(small(case, MOST_CASES), "source")  # texts stay where they are read
    days = n - 500
    return docs.select(
        "doc_id", "source", "lang", "title", F.split_part("text", F.lit("."), F.lit(2)).alias("head"), F.array("lang", "source").alias("keywords"), "text", "weights", "unique", "facility_terms", "promise_terms", "n_candidates",
        F.array("lang").alias("region_terms"), names("en", "fr").alias("allowed"), names("de").alias("other_regions"), names("the").alias("incident_words"), names(*INCIDENT).alias("all_incident_words"), names("other", "mentiona").alias("others"), reasons.alias("reasons"),
        (n % 10 / 10).alias("cos"), R._share(c("weights"), c("text")).alias("overlap"), (n > 1000).alias("strong"), c("text").contains("other").alias("other_hit"), (n % 2 == 1).alias("promise_cand"), days.alias("days"), (days - 14).alias("after_end"), F.lit(None).cast("int").alias("source_days"), (c("lang") == "fr").alias("wide"), c("lang").alias("itype"))


@query(f"WITH {PAIR_SQL} SELECT doc_id, " + ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {k}" for k, x in FEATURE_SQL.items()) + " FROM p")
def q_link_features(spark, d):
    """The 53 features of every pair."""
    return pairs(spark, d).select("doc_id", *(F.round(x, 6).alias(k) for k, x in R.pair_features(RULES, SPECIFIC).items()))


def cross_fitted(spark, d):
    """Not registered, as its many small jobs take over a minute at any size. Scores of every pair by models that saw no document of its group (ten identifiers); the label is a document's quality."""
    features = R.pair_features(RULES, SPECIFIC)
    label = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).cast("double").alias("label"))
    rows = pairs(spark, d).select("doc_id", F.floor(F.col("doc_id") / 10).alias("group"), X.tokens(F.col("title")).alias("title_words"), F.transform(X.tokens(F.col("head")), lambda w: F.concat(F.lit("h:"), w)).alias("head_words"), *(x.alias(k) for k, x in features.items()))
    rows = rows.join(label, "doc_id", "left").checkpoint()
    return R.cross_fit(rows, "group", list(features), folds=3, kind="avg", rounds=5)
