"""Retrieval metrics over a run (query_id, doc_id, rank from 1) and judgements (query_id, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run's rows of judged queries, with rel (0 where unjudged)."""
    known = qrels.select("query_id").distinct()
    return run.join(known, "query_id", "left_semi").join(qrels.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left").select("query_id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))


def _frame(queries: DataFrame, values: DataFrame, name: str) -> DataFrame:
    return queries.join(values, "query_id", "left").select("query_id", F.coalesce(name, F.lit(0.0)).alias(name))


def _queries(run: DataFrame, qrels: DataFrame, queries: DataFrame | None) -> DataFrame:
    """Judged queries: those of the run, or of ``queries`` where empty runs must count."""
    return (queries or run).select("query_id").distinct().join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def ndcg(run: DataFrame, qrels: DataFrame, k: int, queries: DataFrame | None = None, name: str = "ndcg") -> DataFrame:
    """(query_id, ndcg): gain 2^rel - 1, discount log2(rank + 1), against the ideal order of the positive judgements."""
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    dcg = judged(run, qrels).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rel"))
    ideal = qrels.where("rel > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("ideal"))
    return _frame(_queries(run, qrels, queries), dcg.join(ideal, "query_id").select("query_id", (F.col("dcg") / F.col("ideal")).alias(name)), name)


def _relevant(qrels: DataFrame) -> DataFrame:
    return qrels.where("rel > 0").groupBy("query_id").agg(F.count("*").alias("relevant"))


def average_precision(run: DataFrame, qrels: DataFrame, k: int, queries: DataFrame | None = None, name: str = "ap") -> DataFrame:
    """(query_id, ap): precision at each hit, summed, over the number of all relevant documents."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = judged(run, qrels).where(F.col("rank") <= k).withColumn("hit", (F.col("rel") > 0).cast("int")).withColumn("seen", F.sum("hit").over(w))
    total = hits.groupBy("query_id").agg(F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("s"))
    return _frame(_queries(run, qrels, queries), total.join(_relevant(qrels), "query_id").select("query_id", (F.col("s") / F.col("relevant")).alias(name)), name)


def recall(run: DataFrame, qrels: DataFrame, k: int, queries: DataFrame | None = None, name: str = "recall") -> DataFrame:
    """(query_id, recall): hits among the first k over all relevant documents."""
    hits = judged(run, qrels).where((F.col("rank") <= k) & (F.col("rel") > 0)).groupBy("query_id").agg(F.count("*").alias("h"))
    return _frame(_queries(run, qrels, queries), hits.join(_relevant(qrels), "query_id").select("query_id", (F.col("h") / F.col("relevant")).alias(name)), name)


def reciprocal_rank(run: DataFrame, qrels: DataFrame, k: int, queries: DataFrame | None = None, name: str = "rr") -> DataFrame:
    """(query_id, rr): one over the rank of the first hit among the first k."""
    first = judged(run, qrels).where((F.col("rank") <= k) & (F.col("rel") > 0)).groupBy("query_id").agg(F.min("rank").alias("r"))
    return _frame(_queries(run, qrels, queries), first.select("query_id", (F.lit(1.0) / F.col("r")).alias(name)), name)


REPORT = (("ndcg_10", ndcg, 10), ("ndcg_100", ndcg, 100), ("map_100", average_precision, 100), ("recall_10", recall, 10), ("recall_100", recall, 100), ("mrr_10", reciprocal_rank, 10))


def evaluate(run: DataFrame, qrels: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row: the mean of each metric over the judged queries, and how many queries there are, are judged and are skipped."""
    base = _queries(run, qrels, queries)
    every = base
    for name, metric, k in REPORT:
        every = every.join(metric(run, qrels, k, queries, name), "query_id", "left")
    means = every.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n, _, _ in REPORT], F.count("*").alias("queries_judged"))
    total = (queries or run).select("query_id").distinct().agg(F.count("*").alias("queries"))
    return means.crossJoin(total).withColumn("queries_skipped", F.col("queries") - F.col("queries_judged"))
