"""Missing links: candidates, scores, ranks, confidence, recovery metrics. Relational throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import fixed as X
from gossamer.operators.graph import both_ways, degrees


#: Links of a node beyond which its wedges are not made.
HUB = 256


def link_types(spark) -> DataFrame:
    return spark.createDataFrame(X.LINK_TYPES, "type_a string, type_b string, relation string, template string")


def candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unlinked pairs (i < j by node_idx) of linkable types, with the relation.

    Nodes are joined through the type table first, so a pair is only made if its types fit.
    """
    types = link_types(nodes.sparkSession)
    both = types.select("type_a", "type_b", "relation").unionByName(types.select(F.col("type_b").alias("type_a"), F.col("type_a").alias("type_b"), "relation"))
    a = nodes.select("graph_id", F.col("node").alias("node_a"), F.col("node_idx").alias("i"), F.col("type").alias("type_a"))
    b = nodes.select("graph_id", F.col("node").alias("node_b"), F.col("node_idx").alias("j"), F.col("type").alias("type_b"))
    pairs = a.join(F.broadcast(both), "type_a").join(b, ["graph_id", "type_b"]).where("i < j")
    linked = edges.select("graph_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    out = pairs.withColumns({"lo": F.least("node_a", "node_b"), "hi": F.greatest("node_a", "node_b")}).join(linked, ["graph_id", "lo", "hi"], "left_anti")
    return out.select("graph_id", "i", "j", "node_a", "node_b", "type_a", "type_b", "relation")


def adamic_adar(nodes: DataFrame, edges: DataFrame, pairs: DataFrame | None = None, hub: int = HUB) -> DataFrame:
    """Candidates with the score: sum over common neighbours of 1 / ln(degree).

    Common neighbours come from wedges on the middle node, so only pairs that share one are made. A node of more than
    ``hub`` links would make wedges by the square of them: there the candidates themselves are joined to its
    neighbours, twice, which is linear in both.
    """
    pairs = candidates(nodes, edges) if pairs is None else pairs
    way = both_ways(edges).select("graph_id", F.col("node").alias("mid"), "other")
    weight = degrees(edges).select("graph_id", F.col("node").alias("mid"), "degree", (1 / F.greatest(F.log("degree"), F.lit(1e-10))).alias("w"))
    left = way.join(weight, ["graph_id", "mid"]).withColumnRenamed("other", "node_a")
    few, many = left.where(F.col("degree") <= hub).drop("degree"), left.where(F.col("degree") > hub).drop("degree")
    wedge = few.join(way.withColumnRenamed("other", "node_b"), ["graph_id", "mid"]).where("node_a <> node_b")
    far = many.select("graph_id", "mid", F.col("node_a").alias("node_b"))
    at_hubs = pairs.select("graph_id", "node_a", "node_b").join(many, ["graph_id", "node_a"]).join(far, ["graph_id", "mid", "node_b"])
    each = wedge.select("graph_id", "node_a", "node_b", "w").unionByName(at_hubs.select("graph_id", "node_a", "node_b", "w"))
    score = each.groupBy("graph_id", "node_a", "node_b").agg(F.sum("w").alias("score"))
    return pairs.join(score, ["graph_id", "node_a", "node_b"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def ranked(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("graph_id").orderBy(F.round("score", 12).desc(), "i", "j")
    return scored.withColumn("rank", F.row_number().over(order))


def with_confidence(scored: DataFrame) -> DataFrame:
    """Bands by the percentiles of all of a graph's candidates: before any top-k."""
    s = F.round("score", 12)
    p = scored.groupBy("graph_id").agg(F.percentile(s, 0.5).alias("p50"), F.percentile(s, 0.75).alias("p75"), F.max(s).alias("top"), F.count("*").alias("n"))
    p = p.select("graph_id", F.when(F.col("n") > 1, F.col("p50")).otherwise(0.0).alias("p50"), F.when(F.col("n") > 3, F.col("p75")).otherwise(F.col("top")).alias("p75"))
    band = F.when(s >= F.col("p75"), "high").when(s >= F.col("p50"), "medium").otherwise("low")
    return scored.join(p, "graph_id").withColumn("confidence", band).drop("p50", "p75")


def explained(predictions: DataFrame) -> DataFrame:
    """The relation in words, its two ends in the relation's own order."""
    t = link_types(predictions.sparkSession).select("relation", F.col("type_a").alias("_first"), "template")
    first = F.when(F.col("type_a") == F.col("_first"), F.col("node_a")).otherwise(F.col("node_b"))
    second = F.when(F.col("type_a") == F.col("_first"), F.col("node_b")).otherwise(F.col("node_a"))
    words = F.replace(F.replace(F.col("template"), F.lit("{a}"), first), F.lit("{b}"), second)
    return predictions.join(F.broadcast(t), "relation").withColumn("explanation", words).drop("_first", "template")


def top_links(scored: DataFrame, k: int = 10) -> DataFrame:
    return explained(ranked(with_confidence(scored)).where(F.col("rank") <= k))


def recovery_metrics(ranks: DataFrame, hidden: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """Per graph: mrr over hidden links that are ranked, mrr_all over all, hits at k, mean rank, auc.

    ``hidden`` has graph_id, src and dst; ``ranks`` is what ``ranked`` gives.
    """
    h = hidden.select("graph_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.lit(1).alias("hit"))
    r = ranks.withColumns({"lo": F.least("node_a", "node_b"), "hi": F.greatest("node_a", "node_b")}).join(h, ["graph_id", "lo", "hi"], "left")
    hit = F.col("hit") == 1
    per = r.groupBy("graph_id").agg(
        F.count_if(hit).alias("n_found"), F.count("*").alias("n_candidates"), F.sum(F.when(hit, 1.0 / F.col("rank"))).alias("inverse"), F.avg(F.when(hit, F.col("rank"))).alias("mean_rank"),
        F.sum(F.when(hit, F.col("rank"))).alias("rank_sum"), *(F.count_if(hit & (F.col("rank") <= k)).alias(f"at_{k}") for k in ks),
    )
    n = hidden.groupBy("graph_id").agg(F.count("*").alias("n_hidden"))
    out = n.join(per, "graph_id")
    found, others = F.col("n_found"), F.col("n_candidates") - F.col("n_found")
    auc = F.when((found > 0) & (others > 0), 1 - (F.col("rank_sum") - found * (found + 1) / 2) / (found * others))
    return out.select(
        "graph_id", "n_hidden", "n_found", "n_candidates", F.coalesce(F.col("inverse") / found, F.lit(0.0)).alias("mrr"), F.coalesce(F.col("inverse") / F.col("n_hidden"), F.lit(0.0)).alias("mrr_all"),
        "mean_rank", auc.alias("auc"), *((F.col(f"at_{k}") / F.col("n_hidden")).alias(f"hits_{k}") for k in ks),
    )
