"""Further operators: seed metadata, corpus scores, campaigns, traces, costs, labels and report figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import K1, B
from tessera.operators.graphs import KEY
from tessera.operators.snapshot import threshold_clusters
from tessera.runtime import materialise


def corpus_scores(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """query, doc, score: BM25 of documents for query documents, where all documents are the corpus.

    ``terms``: doc, term, tf. ``queries``: query (a doc). Query terms meet the documents' terms by equality; sums are per pair.
    """
    size = terms.groupBy("doc").agg(F.sum("tf").cast("double").alias("len"))
    total = size.agg(F.avg("len").alias("mean"), F.count(F.lit(1)).cast("double").alias("docs"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    mine = terms.join(queries.select(F.col("query").alias("doc")), "doc", "left_semi").select(F.col("doc").alias("query"), "term")
    # one row with the corpus's mean length and size
    found = terms.join(mine, "term").where("doc != query").join(df, "term").join(size, "doc").crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return found.groupBy("query", "doc").agg(F.sum(weight).alias("score"))


def sketch64(terms: DataFrame) -> DataFrame:
    """doc, sketch: a 64-bit similarity sketch; bit i is set where terms with that bit in the first 8 bytes of their MD5 outweigh the others."""
    digest = F.md5(F.col("term").cast("binary"))
    half = {k: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in (0, 1)}
    hashed = terms.select("doc", half[0].alias("h1"), half[1].alias("h0"), "tf")
    sums = hashed.groupBy("doc").agg(*(F.sum(F.when(F.expr(f"((h{i // 32} >> {i % 32}) & 1) = 1"), F.col("tf")).otherwise(-F.col("tf"))).alias(f"b{i}") for i in range(64)))
    bits: Column = F.lit(0).cast("long")
    for i in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return sums.select("doc", bits.alias("sketch"))


def rare_terms(terms: DataFrame, k: int) -> DataFrame:
    """doc, term: the k rarest terms of each document (ties: by term)."""
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("doc").orderBy("df", "term")
    return terms.join(df, "term").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("doc", "term")


def overlay(snapshot: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot with live rows in place of its rows of the same key, and with live rows that it lacks."""
    return snapshot.join(live.select(*keys), keys, "left_anti").unionByName(live.select(snapshot.columns))


def campaigns(evidence: DataFrame) -> DataFrame:
    """contract, campaign: contracts connected by shared evidence (contract, evidence).

    Each piece of evidence ties its contracts to the smallest of them; components of these ties are campaigns.
    """
    own = evidence.select("contract", "evidence").distinct()
    first = own.groupBy("evidence").agg(F.min("contract").alias("right"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = own.join(first, "evidence").where("contract != right").select(F.col("contract").alias("left"), "right").distinct()
    return threshold_clusters(ties).select(F.col("name").alias("contract"), F.col("cluster").alias("campaign"))


def campaign_confidence(evidence: DataFrame, members: DataFrame) -> DataFrame:
    """campaign, contracts, shared, confidence: high with a shared deployer or recipient of value, medium with a shared address.

    ``evidence``: contract, evidence ("class:value"); ``members``: contract, campaign. Shared is what two contracts of one campaign have.
    """
    own = evidence.select("contract", "evidence").distinct().join(members, "contract")
    shared = own.groupBy("campaign", "evidence").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    strong = F.col("evidence").startswith("shared_deployer:") | F.col("evidence").startswith("shared_value_recipient:")
    level = F.max(F.when(strong, 2).when(F.col("evidence").startswith("shared_address:"), 1).otherwise(0))
    found = shared.groupBy("campaign").agg(F.count(F.lit(1)).alias("shared"), level.alias("level"))
    size = members.groupBy("campaign").agg(F.count(F.lit(1)).alias("contracts"))
    return size.join(found, "campaign", "left").select("campaign", "contracts", F.coalesce("shared", F.lit(0)).alias("shared"), F.when(F.col("level") == 2, "high").when(F.col("level") == 1, "medium").otherwise("low").alias("confidence"))


def trace(payments: DataFrame, starts: DataFrame, hops: int = 3, frontier: int = 32, low: float = 0.05, high: float = 1.02) -> DataFrame:
    """start_event, hop, event_id, src, dst, usd: money followed from starting payments.

    ``payments``: event_id, src, dst, usd, currency, block, place (in the block). A hop is a payment by the receiver in the same
    currency, in a later block or later in the same one, of ``low`` to ``high`` times the value before, to someone else; the zero
    address neither pays nor receives (its payments are not passed in). At each hop a start keeps its ``frontier`` earliest
    payments, which is part of the measure.
    """
    paid = materialise(payments.where("usd > 0 AND src != dst").select("event_id", "src", "dst", "usd", "currency", "block", "place"), "trace-payments")
    now = paid.join(starts.select("event_id"), "event_id", "left_semi").select(F.col("event_id").alias("start_event"), F.lit(0).alias("hop"), *paid.columns)
    out = now
    for hop in range(1, hops + 1):
        at = now.select("start_event", F.col("dst").alias("src"), "currency", *(F.col(c).alias(f"{c}_0") for c in ("block", "place", "usd")))
        later = (F.col("block") > F.col("block_0")) | (F.col("block") == F.col("block_0")) & (F.col("place") > F.col("place_0"))
        near = paid.join(at, ["src", "currency"]).where(later & (F.col("usd") >= low * F.col("usd_0")) & (F.col("usd") <= high * F.col("usd_0")))
        w = Window.partitionBy("start_event").orderBy("block", "place", "event_id")
        now = near.dropDuplicates(["start_event", "event_id"]).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= frontier).select("start_event", F.lit(hop).alias("hop"), *paid.columns)
        now = materialise(now, "trace-hop")
        out = out.unionByName(now)
    return out.select("start_event", "hop", "event_id", "src", "dst", "usd")


def operator_levels(evidence: DataFrame) -> DataFrame:
    """chain, contract, address, score, level: L1 from 1.5 on, L2 from 0.75 on, else L3."""
    own = evidence.groupBy(*KEY, "address").agg(F.round(F.sum(F.col("weight") * F.col("confidence")), 4).alias("score"))
    return own.withColumn("level", F.when(F.col("score") >= 1.5, "L1").when(F.col("score") >= 0.75, "L2").otherwise("L3"))


def weak_labels(features: DataFrame) -> DataFrame:
    """chain, contract, label: by the share of operators and whether value went out."""
    share = F.try_divide(F.col("operators"), F.col("operators") + F.col("victims"))
    return features.select(*KEY, F.when((share >= 0.99) & (F.col("gross_usd") > 0), "likely_malicious").when(F.col("victims") > 0, "has_victims").otherwise("unknown").alias("label"))


def signals(transfers: DataFrame, fast: int = 86_400) -> DataFrame:
    """chain, contract: receivers, reciprocal pairs, star distributors, seconds from the first to the next sender's move, fast spread."""
    pairs = transfers.select(*KEY, "src", "dst").distinct()
    both = pairs.join(pairs.select(*KEY, F.col("src").alias("dst"), F.col("dst").alias("src")), [*KEY, "src", "dst"], "left_semi").where("src < dst").groupBy(*KEY).agg(F.count(F.lit(1)).alias("reciprocal"))
    sent = pairs.groupBy(*KEY, F.col("src").alias("address")).agg(F.count(F.lit(1)).alias("o"))
    got = transfers.groupBy(*KEY, F.col("dst").alias("address")).agg(F.count(F.lit(1)).alias("i"))
    stars = sent.join(got, [*KEY, "address"], "left").where("o >= 3 AND coalesce(i, 0) <= 1").groupBy(*KEY).agg(F.count(F.lit(1)).alias("stars"))
    base = transfers.groupBy(*KEY).agg(F.countDistinct("dst").alias("receivers"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    delay = F.col("last_ts") - F.col("first_ts")
    return base.join(both, KEY, "left").join(stars, KEY, "left").select(*KEY, "receivers", F.coalesce("reciprocal", F.lit(0)).alias("reciprocal"), F.coalesce("stars", F.lit(0)).alias("stars"), delay.alias("delay"), ((delay > 0) & (delay <= fast)).alias("fast_spread"))
