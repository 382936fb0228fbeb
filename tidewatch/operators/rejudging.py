"""Judgements kept up to date batch by batch: only the cases that a batch touches are read and judged again.

Links, promises and cases are logs under a shared folder: a batch appends the
new versions of its rows, dealt to buckets by case. What holds of a case is the
last version of each of its rows. A batch's judgements are appended too, with
the batch's number, the version of the rules and a digest of the promises they
rest on, so that a judgement that no longer holds is found by a join.

A batch counts once its line in ``commits`` is written, which is the last step.
One that failed is simply applied again and replaces what it left behind.
Readers start at the last compaction, which writes all rows that hold as one
batch, so the number of files that a bucket has stays bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .judging import Thresholds, status_rules

#: Buckets up to which a scan names them; beyond it the join with the touched cases prunes alone.
NAMED_BUCKETS = 4096


def promise_digest(promises: DataFrame) -> DataFrame:
    """case_id, promise_set: a digest of the different (action, deadline) of the promises that are tracked; the same in any order.

    It is the number of them and the sum of 60 bits of each one's MD5: sums of
    parts add up, so no case's promises have to meet in one place.
    """
    one = F.concat_ws(":", "action", F.col("deadline").cast("string"))
    kept = promises.where("trackable AND active").select("case_id", one.alias("x")).distinct()
    bits = F.conv(F.substring(F.md5("x"), 1, 15), 16, 10).cast("decimal(20,0)")
    return kept.groupBy("case_id").agg(F.concat_ws("-", F.count("*").cast("string"), F.sum(bits).cast("string")).alias("promise_set"))


def buckets_for(rows: int, each: int = 200_000) -> int:
    """Buckets of about ``each`` rows, 8 at least: what a batch reads of a log follows from the cases it touches, not from the log."""
    return max(8, -(-rows // each))


class JudgedCases:
    """A table of judgements under ``path`` and the logs it is made from.

    ``cases`` (case_id, occurred), ``links`` and ``promises`` are as
    ``status_rules`` takes them; rows with a new version of the same key replace
    the old one, rows with ``gone`` true take it away. Rows without a case_id are
    kept but never judged.
    """

    KEYS = {"cases": ["case_id"], "links": ["case_id", "part", "supp", "line"], "promises": ["case_id", "part", "supp"]}

    def __init__(self, spark: SparkSession, path: str, as_of: str, thresholds: Thresholds = Thresholds(), buckets: int = 64):
        self.spark, self.path, self.as_of, self.t, self.buckets = spark, path.rstrip("/"), as_of, thresholds, buckets
        self._found: dict[tuple[str, int], DataFrame | None] = {}  # what is written doesn't change, so its files are listed once
        self.version = "-".join(str(getattr(thresholds, f)) for f in thresholds.__dataclass_fields__) + "@" + as_of

    # commits

    def commits(self) -> list[tuple[int, str]]:
        """(batch, kind) of all that count, in order; a line for each batch since the start."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return []
        return sorted((r.batch, r.kind) for r in self.spark.read.schema("batch int, kind string").parquet(f"{self.path}/commits").collect())

    def _commit(self, batch: int, kind: str) -> None:
        self.spark.createDataFrame([(batch, kind)], "batch int, kind string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _live(self) -> list[int]:
        """Batches that readers of a log look at: from the last compaction on."""
        found = self.commits()
        start = max((b for b, kind in found if kind == "base"), default=0)
        return [b for b, _ in found if b >= start]

    # logs

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("case_id"), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, batch: int) -> None:
        # balanced by size, so a case with very many rows is more than one task's work
        self._found.pop((name, batch), None)
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={batch}")

    def _append(self, name: str, rows: DataFrame, batch: int) -> None:
        gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
        self._write(name, rows.withColumn("gone", gone), batch)

    def _part(self, name: str, batch: int) -> DataFrame | None:
        """A batch's rows of a log, None if it has none."""
        if self._found.get((name, batch)) is None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/batch={batch}")
            there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
            self._found[name, batch] = self.spark.read.option("basePath", f"{self.path}/{name}/batch={batch}").parquet(f"{self.path}/{name}/batch={batch}").withColumn("batch", F.lit(batch)) if there else None
        return self._found[name, batch]

    def _read(self, name: str, batches: list[int], buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of some batches, with ``batch``; only the named buckets are scanned."""
        out = None
        for b in batches:
            rows = self._part(name, b)
            if rows is not None:
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is not None and buckets is not None and len(buckets) <= NAMED_BUCKETS:
            out = out.where(F.col("bucket").isin(buckets))
        return out

    def held(self, name: str, touched: DataFrame | None = None, buckets: list[int] | None = None, batches: list[int] | None = None) -> DataFrame:
        """The rows that hold, of all cases or of the ``touched`` ones (case_id)."""
        rows = self._read(name, self._live() if batches is None else batches, buckets)
        if touched is not None:
            rows = rows.join(touched, "case_id", "left_semi")
        keys = self.KEYS[name]
        last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *(c for c in rows.columns if c not in (*keys, "bucket", "batch")))).alias("row"))
        return last.select(*keys, "row.*").drop("batch").where("NOT gone").drop("gone")

    # judgements

    def apply(self, cases: DataFrame | None = None, links: DataFrame | None = None, promises: DataFrame | None = None) -> int:
        """Take in a batch of new and changed rows and judge the cases it touches; the batch's number."""
        batch = len(self.commits())
        changed = {"cases": cases, "links": links, "promises": promises}
        touched = None
        for name, rows in changed.items():
            if rows is not None:
                self._append(name, rows, batch)
                own = self._read(name, [batch])
                if own is not None:
                    own = own.where("case_id IS NOT NULL").select("case_id", "bucket")
                    touched = own if touched is None else touched.union(own)
        if touched is not None:
            # written, as it is read for the buckets and again for each log
            touched.distinct().write.mode("overwrite").parquet(f"{self.path}/touched/batch={batch}")
            self._judge(self.spark.read.parquet(f"{self.path}/touched/batch={batch}"), batch)
        self._commit(batch, "batch")
        return batch

    def _judge(self, touched: DataFrame, batch: int) -> None:
        buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]  # as many as there are buckets at most
        ids, batches = touched.select("case_id"), [*self._live(), batch]
        cases, links, promises = (self._held_or_none(name, ids, buckets, batches) for name in ("cases", "links", "promises"))
        if cases is None:
            return
        code = status_rules(cases, links, promises, self.as_of, self.t)
        out = code.select("case_id", "code", "confidence", "why").join(promise_digest(promises), "case_id", "left")
        self._write("judgements", out.select("*", F.lit(self.version).alias("version")), batch)

    def _held_or_none(self, name: str, ids: DataFrame, buckets: list[int], batches: list[int]) -> DataFrame | None:
        if self._read(name, batches, buckets) is None:
            if name == "cases":
                return None
            empty = {"links": "case_id long, part long, supp long, line int, pub date, signal string, conf int, matches boolean, active boolean", "promises": "case_id long, part long, supp long, active boolean, deadline date, firm boolean, trackable boolean, action string"}[name]
            return self.spark.createDataFrame([], empty)
        return self.held(name, ids, buckets, batches)

    def judgements(self) -> DataFrame:
        """All judgements of committed batches, with their batch; a case has one for each batch that touched it."""
        return self._read("judgements", [b for b, _ in self.commits()])

    def latest(self) -> DataFrame:
        """case_id, code, confidence, why, promise_set, version, last_batch, n_judgements."""
        rows = self.judgements()
        last = rows.groupBy("case_id").agg(F.max_by(F.struct("code", "confidence", "why", "promise_set", "version"), "batch").alias("row"), F.max("batch").alias("last_batch"), F.count("*").alias("n_judgements"))
        return last.select("case_id", "row.*", "last_batch", "n_judgements")

    def stale(self) -> DataFrame:
        """case_id, bucket of cases whose last judgement doesn't hold any more: other rules, other promises, or none at all."""
        now = promise_digest(self.held("promises")).withColumnRenamed("promise_set", "now")
        was = self.latest().select("case_id", "version", "promise_set")
        joined = self.held("cases").select("case_id").join(was, "case_id", "left").join(now, "case_id", "left")
        wrong = F.coalesce(F.col("version") != self.version, F.lit(True)) | ~F.col("promise_set").eqNullSafe(F.col("now"))
        return joined.where(wrong).select("case_id", self._bucket().alias("bucket"))

    def refresh(self) -> int:
        """Judge the stale cases again, as after a change of thresholds or of the day."""
        batch = len(self.commits())
        self._judge(self.stale(), batch)
        self._commit(batch, "batch")
        return batch

    def compact(self) -> int:
        """Write the rows that hold as one batch, from which readers start."""
        batch = len(self.commits())
        for name in self.KEYS:
            if self._read(name, self._live()) is not None:
                self._append(name, self.held(name), batch)
        self._commit(batch, "base")
        return batch


def upsert_links(old: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of a new run over stored links: what a person decided stays.

    ``old`` has the keys, decision, score and ``by_hand`` (confirmed, rejected or
    added by a person), ``found`` the keys, decision and score. A stored decision
    by hand keeps its decision and takes the new score; any other one is replaced,
    and becomes ``dropped`` when the run no longer finds it. ``state`` is new,
    kept, changed, same or dropped.
    """
    a = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("decision", "score", "by_hand")), F.lit(True).alias("_old"))
    b = found.select(*keys, "decision", "score", F.lit(True).alias("_new"))
    j = a.join(b, keys, "full")
    hand = F.coalesce(F.col("_by_hand"), F.lit(False))
    decision = F.when(hand, F.col("_decision")).when(F.col("_new").isNull(), F.lit("dropped")).otherwise(F.col("decision"))
    state = F.when(F.col("_old").isNull(), "new").when(hand, "kept").when(F.col("_new").isNull(), "dropped").when(F.col("_decision").eqNullSafe(F.col("decision")), "same").otherwise("changed")
    return j.select(*keys, decision.alias("decision"), F.coalesce("score", "_score").alias("score"), hand.alias("by_hand"), state.alias("state"))

