"""Re-ranking of links: features of a pair of case and article, classifiers over them, and scores by models that haven't seen the case."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import dates as D
from tidewatch.functions import text as X

#: The gate's reasons that are features, and the features that are conditions on the title by a user's expression.
REASONS = ["region", "facility", "facility-title", "org", "incident", "seed-kw", "kw", "promise-kw"]
TITLE_RULES = ["new_incident", "frame", "action", "policy", "nationwide", "weather", "politics"]
#: Fixed value: a case's unique word without a weight counts as this.
UNIQUE_WEIGHT = 0.6


def _found(terms: Column, text: Column) -> Column:
    return F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: text.contains(t))


def _share(weights: Column, text: Column) -> Column:
    """Weights of the words in a text over the ten largest of all; 1 at most."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    ten = add(F.slice(F.sort_array(F.map_values(weights), asc=False), 1, 10))
    hit = add(F.map_values(F.map_filter(weights, lambda t, _: text.contains(t))))
    return F.when(ten > 0, F.least(F.lit(1.0), hit / ten)).otherwise(0.0)


def pair_features(rules: Mapping[str, str], specific: str) -> dict[str, Column]:
    """Name -> Column of the 53 features of a pair, each a double; what is null counts as absent or 0.

    The pair's columns: title, head (its summary), keywords, text; the case's
    weights (map), and arrays unique, region_terms, facility_terms, allowed,
    other_regions, incident_words, promise_terms; others (facilities of other
    cases), reasons (of the gate; name or name=value), cos, overlap, strong,
    other_hit, promise_cand, days, after_end, source_days, wide, itype,
    all_incident_words and n_candidates. ``rules`` has an expression for each of
    ``TITLE_RULES`` and for natural, traffic (of itype) and quote; ``specific``
    tells a facility's name from a kind of facility.
    """
    c = F.col
    title, head, reasons = (F.coalesce(c("title"), F.lit("")), F.coalesce(c("head"), F.lit("")), F.coalesce(c("reasons"), F.array().cast("array<string>")))
    words = F.coalesce(F.array_join("keywords", " "), F.lit(""))
    weights = F.coalesce(c("weights"), F.create_map().cast("map<string,double>"))
    near, everything = F.concat_ws(" ", title, head), F.concat_ws(" ", title, head, words)
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    n = lambda terms, text: F.size(_found(c(terms), text))
    any_of = lambda terms, text: n(terms, text) > 0
    top = lambda a: F.coalesce(F.array_max(a), F.lit(0.0))
    rival = F.when(F.array_contains(reasons, "facility"), F.array().cast("array<string>")).otherwise(_found(c("others"), c("text")))
    vows = F.filter(F.array_distinct(F.coalesce("promise_terms", F.array().cast("array<string>"))), lambda t: F.length(t) >= 2)

    def reason(name: str) -> Column:
        own = F.get(F.filter(reasons, lambda r: (r == name) | r.startswith(name + "=")), 0)
        return F.when(own.isNull(), 0.0).otherwise(F.coalesce(F.substring_index(own, "=", -1).try_cast("double"), F.lit(1.0)))

    out = {name: c(name) for name in ("cos", "overlap", "strong", "other_hit")}
    out |= {"other_fac_specific": F.exists(rival, lambda f: f.rlike(specific)), "other_fac_generic": F.exists(rival, lambda f: ~f.rlike(specific)), "promise_cand": c("promise_cand")}
    out |= {"g_" + name.replace("-", "_"): reason(name) for name in REASONS}
    out |= {"cap_recur": F.array_contains(reasons, "cap-recur"), "cap_place": F.exists(reasons, lambda r: r.startswith("cap-place"))}
    out |= {"days_log": D.signed_log(c("days")), "late": c("after_end") > 0, "days_after_end_log": D.signed_log(c("after_end")), "src_days_log": D.signed_log(c("source_days"))}
    out |= {"t_overlap": _share(weights, title), "h_overlap": _share(weights, head), "k_overlap": _share(weights, words)}
    out |= {"t_uniq_n": n("unique", title), "th_uniq_n": n("unique", near), "t_uniq_max": top(F.transform(_found(c("unique"), title), lambda u: F.coalesce(weights[u], F.lit(UNIQUE_WEIGHT))))}
    out |= {"t_weight_max": top(F.map_values(F.map_filter(weights, lambda t, _: title.contains(t)))), "n_hit_terms": F.size(_found(F.map_keys(weights), everything))}
    out |= {"t_region": any_of("region_terms", title), "h_region": any_of("region_terms", everything), "t_fac": any_of("facility_terms", title), "h_fac": any_of("facility_terms", everything)}
    out |= {"t_allowed_region": any_of("allowed", title), "t_other_region": any_of("other_regions", title)}
    out |= {"t_" + name: title.rlike(rules[name]) for name in TITLE_RULES}
    out |= {"t_incident_word": n("all_incident_words", title), "t_event_incident": any_of("incident_words", title)}
    out |= {"t_len": F.length(title), "t_ntok": F.size(X.distinct_tokens(title)), "t_quote": title.rlike(rules["quote"])}
    out |= {"wide": c("wide"), "ev_natural": c("itype").rlike(rules["natural"]), "ev_traffic": c("itype").rlike(rules["traffic"]), "ev_cands_log": F.log1p(F.greatest(c("n_candidates"), F.lit(0)))}
    out |= {"t_promise_hits": F.size(_found(vows, title)), "head_promise_hits": F.size(_found(vows, everything))}
    return {name: number(value) for name, value in out.items()}


def classifier(features: list[str], kind: str = "avg", hashed: int = 2**15, rounds: int = 20) -> list[Pipeline]:
    """Classifiers of rows with ``features``, ``title_words`` and ``head_words`` (arrays) and ``label``.

    ``trees``: boosted trees over the numbers; ``linear``: logistic regression
    over the scaled numbers and the hashed words of title and summary, each
    scaled to length 1 by itself; ``avg``: both, whose probabilities are averaged.
    """
    if kind not in ("trees", "linear", "avg"):
        raise ValueError(f"kind={kind}")
    numbers = VectorAssembler(inputCols=features, outputCol="numbers")
    trees = Pipeline(stages=[numbers, GBTClassifier(featuresCol="numbers", maxIter=rounds, stepSize=0.1, seed=0)])
    texts = [s for p in ("title", "head") for s in (HashingTF(inputCol=f"{p}_words", outputCol=f"{p}_n", numFeatures=hashed), Normalizer(inputCol=f"{p}_n", outputCol=f"{p}_v"))]
    scaled = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)
    linear = Pipeline(stages=[numbers, scaled, *texts, VectorAssembler(inputCols=["scaled", "title_v", "head_v"], outputCol="all"), LogisticRegression(featuresCol="all", regParam=1e-3, maxIter=50)])
    return {"trees": [trees], "linear": [linear], "avg": [trees, linear]}[kind]


def probability(models: list, rows: DataFrame) -> DataFrame:
    """``rows`` with p, the mean of the models' probabilities of label 1."""
    kept = rows.columns
    for i, m in enumerate(models):
        scored = m.transform(rows)
        rows = scored.select(*rows.columns, vector_to_array("probability")[1].alias(f"p{i}"))
    return rows.select(*kept, (sum(F.col(f"p{i}") for i in range(len(models))) / len(models)).alias("p"))


def cross_fit(rows: DataFrame, key: str, features: list[str], folds: int = 5, kind: str = "avg", **options) -> DataFrame:
    """``rows`` with fold and p, by a model that was fitted to the rows of other folds; all rows of a key are in one fold. Rows without a label are scored, not learnt from; p is null where the other folds don't have both labels."""
    rows = rows.withColumn("fold", F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds)).cast("int"))
    labelled = rows.where("label IS NOT NULL")
    out = None
    for f in range(folds):
        own, rest = rows.where(F.col("fold") == f), labelled.where(F.col("fold") != f)
        if rest.select("label").distinct().count() < 2:
            scored = own.withColumn("p", F.lit(None).cast("double"))
        else:
            scored = probability([p.fit(rest) for p in classifier(features, kind, **options)], own)
        out = scored if out is None else out.unionAll(scored)
    return out


def nested_thresholds(scored: DataFrame, steps: int = 20) -> DataFrame:
    """fold, threshold, tp, fp, fn, f1 of (fold, label, p): each fold is graded at the threshold that is best by F1 on the other folds; ties to the lower one."""
    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps - 1)), lambda k: k / steps)).alias("threshold")
    hit, truth = F.col("p") >= F.col("threshold"), F.col("label") == 1
    counts = scored.where("label IS NOT NULL").select("fold", "label", "p", grid).groupBy("fold", "threshold").agg(F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn"))
    f1 = lambda tp, fp, fn: F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    every = Window.partitionBy("threshold")
    rest = [F.sum(c).over(every) - F.col(c) for c in ("tp", "fp", "fn")]
    best = Window.partitionBy("fold").orderBy(F.desc("others"), "threshold")
    ranked = counts.withColumn("others", f1(*rest)).withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    return ranked.select("fold", "threshold", "tp", "fp", "fn", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
