"""Tables of the final report: behaviours, economics, data quality, populations, value flow and propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graphs import KEY

#: States of an evidence family.
STATES = ("complete", "empty", "truncated", "failed", "unavailable")
# Known receivers of value (chain, address, role, label).
KNOWN_ENTITIES = (
    ("ethereum", "0x28c6c06298d514db089934071355e5743bf21d60", "cex", "binance_hot_wallet"),
    ("ethereum", "0x503828976d22510aad0201ac7ec88293211d23da", "cex", "coinbase_hot_wallet"),
    ("ethereum", "0x267be1c1d684f78cb4f6a176c4911b741e4ffdc0", "cex", "kraken_hot_wallet"),
    ("ethereum", "0x8315177ab297ba92a06054ce80a67ed4dbd7ed3a", "bridge", "arbitrum_one_bridge"),
    ("ethereum", "0x99c9fc46f92e8a1c0dec1b1747d010903e884be1", "bridge", "optimism_standard_bridge"),
    ("ethereum", "0xa0c68c638235ee32657e8f720a23cec1bfc77c77", "bridge", "polygon_bridge"),
    ("ethereum", "0xd90e2f925da726b50c4ed8d0fb90ad053324f31b", "mixer", "tornado_cash_0_1_eth"),
    ("ethereum", "0x47ce0c6ed5b0ce3d3a51fdb1c52dc66a7c3c2936", "mixer", "tornado_cash_1_eth"),
    ("ethereum", "0x910cbd523d972eb0a6f4cae4618ad62622b39dbf", "mixer", "tornado_cash_10_eth"),
)


def behaviour_table(instances: DataFrame, moves: DataFrame, roles: DataFrame, complete: DataFrame) -> DataFrame:
    """kind, contracts, instances, addresses, nfts, buyers, exposure_usd, denominator, coverage.

    ``instances``: kind, chain, contract, instance, address. Only contracts of complete evidence (``complete``: chain, contract)
    count, above and below. An NFT is linked by a move of a member, a buyer and the exposure by a sale of a member to a victim.
    """
    own = instances.join(complete, KEY, "left_semi")
    size = own.groupBy("kind").agg(F.countDistinct(*KEY).alias("contracts"), F.countDistinct(*KEY, "instance").alias("instances"), F.countDistinct("chain", "address").alias("addresses"))
    member = own.select("kind", *KEY, F.col("address").alias("src")).distinct()
    nfts = moves.join(member, [*KEY, "src"]).groupBy("kind").agg(F.countDistinct(*KEY, "token").alias("nfts"))
    victim = roles.where("role = 'victim'").select(*KEY, F.col("address").alias("dst"))
    sold = moves.where("is_sale").join(victim, [*KEY, "dst"], "left_semi").join(member, [*KEY, "src"])
    buyers = sold.groupBy("kind").agg(F.countDistinct("chain", "dst").alias("buyers"), F.round(F.sum("usd"), 2).alias("exposure_usd"))
    # one row: the number of complete contracts
    out = size.join(nfts, "kind", "left").join(buyers, "kind", "left").crossJoin(F.broadcast(complete.distinct().agg(F.count(F.lit(1)).alias("denominator"))))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("nfts", "buyers")} | {"exposure_usd": F.coalesce("exposure_usd", F.lit(0.0))}
    return out.withColumns(zero).withColumn("coverage", F.round(F.try_divide("contracts", "denominator"), 6))


def state_histogram(evidence: DataFrame, families: list[str]) -> DataFrame:
    """family, state, contracts: how many contracts have each of the five states in each family (also those that none has)."""
    states = F.explode(F.array(*map(F.lit, STATES))).alias("state")
    long = evidence.select(F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.col(f).alias("found")) for f in families))).alias("x")).select("x.*")
    return long.groupBy("family", "found").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("found", "n"))).alias("n")).select("family", "n", states).select("family", "state", F.coalesce(F.element_at("n", F.col("state")), F.lit(0)).alias("contracts"))


def pricing_state(priced: Column, unpriced: Column) -> Column:
    return F.when(priced + unpriced == 0, "empty").when(unpriced == 0, "complete").when(priced == 0, "unpriced").otherwise("partial")


def population(counts: DataFrame) -> DataFrame:
    """chain, contract, population, complete of (chain, contract, provider, snapshot, fallback).

    The provider's count if it is complete (not null), else the snapshot's, else the fallback; never below the fallback.
    """
    best = F.coalesce("provider", "snapshot", "fallback")
    return counts.select(*KEY, F.greatest(best, F.coalesce("fallback", F.lit(0))).alias("population"), F.col("provider").isNotNull().alias("complete"))


def infringing(listed: DataFrame, relations: DataFrame, totals: DataFrame) -> DataFrame:
    """chain, contract, listed, fallback, nfts: NFTs that suspicious relations name, or all of a contract that they name whole.

    ``listed``: chain, contract, row_order; ``relations``: chain, contract of all relations; ``totals``: chain, contract, nfts.
    """
    named = listed.groupBy(*KEY).agg(F.countDistinct("row_order").alias("listed"))
    all_of = totals.select(*KEY, F.col("nfts").alias("whole"))
    own = relations.select(*KEY).distinct().join(named, KEY, "left").join(all_of, KEY, "left")
    fallback = F.when(F.col("listed").isNull(), F.coalesce("whole", F.lit(0))).otherwise(F.lit(0))
    return own.select(*KEY, F.coalesce("listed", F.lit(0)).alias("listed"), fallback.alias("fallback")).withColumn("nfts", F.col("listed") + F.col("fallback"))


def flow_classes(flows: DataFrame, entities: DataFrame) -> DataFrame:
    """chain, to_role, edges, receivers, usd, unpriced, gap: value by the role of its receiver.

    ``flows``: chain, address (of the receiver), usd or null; ``entities``: chain, address, role of known exchanges, bridges and
    mixers; all other receivers are external wallets. ``gap``: the share of edges without a price.
    """
    known = entities.select(F.lower("chain").alias("chain"), F.lower("address").alias("address"), "role")
    own = flows.withColumns({"chain": F.lower("chain"), "address": F.lower("address")}).join(F.broadcast(known), ["chain", "address"], "left")  # a fixed list
    out = own.groupBy("chain", F.coalesce("role", F.lit("external_wallet")).alias("to_role")).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("address").alias("receivers"), F.round(F.sum("usd"), 2).alias("usd"), F.count(F.when(F.col("usd").isNull(), 1)).alias("unpriced"))
    return out.withColumn("gap", F.round(F.try_divide("unpriced", "edges"), 6))


def propagation_nodes(moves: DataFrame, roles: DataFrame) -> DataFrame:
    """chain, contract, address, role, sent, received, first_ts: the nodes of the graph of spread."""
    ends = moves.select(*KEY, "ts", F.explode(F.array(F.struct(F.col("src").alias("address"), F.lit(1).alias("s")), F.struct(F.col("dst").alias("address"), F.lit(0).alias("s")))).alias("e")).select(*KEY, "ts", "e.*")
    size = ends.groupBy(*KEY, "address").agg(F.sum("s").alias("sent"), F.sum(1 - F.col("s")).alias("received"), F.min("ts").alias("first_ts"))
    return size.join(roles, [*KEY, "address"]).select(*KEY, "address", "role", "sent", "received", "first_ts")


def token_paths(moves: DataFrame) -> DataFrame:
    """chain, contract, token, step, src, dst, ts: every token's moves in order."""
    w = Window.partitionBy(*KEY, "token").orderBy("ts", "event_id")
    return moves.select(*KEY, "token", F.row_number().over(w).cast("long").alias("step"), "src", "dst", "ts")


def propagation_summary(moves: DataFrame) -> DataFrame:
    """chain, contract, addresses, edges, tokens, longest_path, largest_fan_out."""
    edges = moves.select(*KEY, "src", "dst").distinct()
    nodes = moves.select(*KEY, F.explode(F.array("src", "dst")).alias("a")).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("addresses"))
    fan = edges.groupBy(*KEY, "src").agg(F.count(F.lit(1)).alias("n")).groupBy(*KEY).agg(F.sum("n").alias("edges"), F.max("n").alias("largest_fan_out"))
    path = moves.groupBy(*KEY, "token").agg(F.count(F.lit(1)).alias("n")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("tokens"), F.max("n").alias("longest_path"))
    return nodes.join(fan, KEY).join(path, KEY).select(*KEY, "addresses", "edges", "tokens", "longest_path", "largest_fan_out")
