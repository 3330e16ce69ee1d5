"""Attribution of addresses and detectors of suspicious behaviour, per contract (chain, contract).

``moves``: event_id, chain, contract, token, src, dst, ts, is_sale, usd (null for transfers and unpriced sales).
``holders``: chain, contract, token, owner. ``roles``: chain, contract, address, role ('operator' or 'victim').
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graphs import KEY, condensed, degrees, edges, layered_paths, strong_components


def sales_of(moves: DataFrame) -> DataFrame:
    return moves.where("is_sale")


def transfers_of(moves: DataFrame) -> DataFrame:
    return moves.where("NOT is_sale")


def holders(moves: DataFrame) -> DataFrame:
    """The receiver of each token's last move."""
    return moves.groupBy(*KEY, "token").agg(F.max_by("dst", F.struct("ts", "event_id")).alias("owner"))


def graphs_of_transfers(moves: DataFrame) -> DataFrame:
    """chain, contract, address, component: strongly connected components of the transfers."""
    return strong_components(edges(transfers_of(moves)))


def graphs_of_sales(moves: DataFrame) -> DataFrame:
    """chain, contract, address, component: strongly connected components of the sales."""
    return strong_components(edges(sales_of(moves)))


def victims(moves: DataFrame, held: DataFrame) -> DataFrame:
    """chain, contract, address, token: paid acquirers that still hold the same token."""
    paid = sales_of(moves).where("usd > 0").select(*KEY, "token", F.col("dst").alias("owner")).distinct()
    return held.join(paid, [*KEY, "token", "owner"], "left_semi").select(*KEY, F.col("owner").alias("address"), "token")


def roles(moves: DataFrame, held: DataFrame) -> DataFrame:
    """Victims, and everyone else seen as an operator."""
    seen = moves.select(*KEY, F.explode(F.array("src", "dst")).alias("address")).distinct()
    v = victims(moves, held).select(*KEY, "address").distinct().withColumn("v", F.lit(True))
    return seen.join(v, [*KEY, "address"], "left").select(*KEY, "address", F.when(F.col("v"), "victim").otherwise("operator").alias("role"))


def five_roles(moves: DataFrame, held: DataFrame, controllers: DataFrame, flows: DataFrame, components: DataFrame) -> DataFrame:
    """chain, contract, address, role: suspected_operator, corrupted_victim, likely_victim, suspected_colluder or neutral.

    Operators are controllers and both ends of withdrawals and cash-outs (``flows``: chain, contract, src, dst). A paid buyer that
    passed tokens on is a corrupted victim, one that still holds one a likely victim. Others are neutral, but for those in a cycle
    of sales (``components``: of the sale graph) with an operator, who are colluders.
    """
    key = [*KEY, "address"]
    ends = F.explode(F.array("src", "dst")).alias("address")
    everyone = moves.select(*KEY, ends).unionByName(controllers.select(*key)).unionByName(held.select(*KEY, F.col("owner").alias("address"))).distinct()

    def mark(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*key).distinct().withColumn(name, F.lit(True))

    operator = controllers.select(*key).unionByName(flows.select(*KEY, ends)).distinct()
    paid = sales_of(moves).where("usd > 0").select(*KEY, F.col("dst").alias("address"))
    own = everyone.join(mark(operator, "operator"), key, "left").join(mark(paid, "paid"), key, "left")
    own = own.join(mark(moves.select(*KEY, F.col("src").alias("address")), "passed"), key, "left").join(mark(held.withColumnRenamed("owner", "address"), "holds"), key, "left")
    ring = components.join(operator, key, "left").groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("n"))
    led = components.join(operator, key, "left_semi").select(*KEY, "component").distinct()
    rings = components.join(ring.where("n >= 2").join(led, [*KEY, "component"], "left_semi"), [*KEY, "component"], "left_semi")
    own = own.join(mark(rings, "ring"), key, "left")
    role = F.when(F.col("operator"), "suspected_operator").when(F.col("paid") & F.col("passed"), "corrupted_victim").when(F.col("paid") & F.col("holds"), "likely_victim").when(F.col("ring"), "suspected_colluder").otherwise("neutral")
    return own.select(*key, role.alias("role"))


def early_features(moves: DataFrame, victims: DataFrame, windows: tuple[int, ...] = (60, 3600, 86400)) -> DataFrame:
    """chain, contract, window, moves, mints, sales, senders, usd, sale_observed, victim_observed, future_positive.

    What is seen of a contract in the first seconds after its first move, and whether its first sale or victim is still to come.
    ``victims``: chain, contract, ts of their acquisitions.
    """
    first = moves.groupBy(*KEY).agg(F.min("ts").alias("start"), F.min(F.when(F.col("is_sale"), F.col("ts"))).alias("sale"))
    hurt = victims.groupBy(*KEY).agg(F.min("ts").alias("victim"))
    minted = moves.groupBy(*KEY, "token").agg(F.min(F.struct("ts", "event_id")).alias("m")).select(*KEY, F.col("m.event_id").alias("event_id"), F.lit(True).alias("mint"))
    base = first.join(hurt, KEY, "left").withColumn("window", F.explode(F.array(*map(F.lit, windows)))).withColumn("until", F.col("start") + F.col("window"))
    inside = moves.join(minted, [*KEY, "event_id"], "left").join(base.select(*KEY, "window", "until"), KEY).where("ts <= until")
    seen = inside.groupBy(*KEY, "window").agg(F.count(F.lit(1)).alias("moves"), F.count("mint").alias("mints"), F.count(F.when(F.col("is_sale"), 1)).alias("sales"), F.countDistinct("src").alias("senders"), F.round(F.sum(F.coalesce("usd", F.lit(0.0))), 4).alias("usd"))
    by = {"sale_observed": F.col("sale") <= F.col("until"), "victim_observed": F.col("victim") <= F.col("until"), "future_positive": (F.col("sale") > F.col("until")) | (F.col("victim") > F.col("until"))}
    return base.join(seen, [*KEY, "window"]).select(*KEY, "window", "moves", "mints", "sales", "senders", "usd", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in by.items()))


def evidence_rows(moves: DataFrame, held: DataFrame, graph: DataFrame, components: DataFrame, controllers: DataFrame | None = None, deployers: DataFrame | None = None, flows: DataFrame | None = None, mints: DataFrame | None = None) -> DataFrame:
    """chain, contract, address, kind, weight, confidence: what speaks about each address, each kind once.

    ``graph``: transfer edges; ``components``: of the sale graph. Optional: controllers and deployers (chain, contract, address),
    flows (chain, contract, dst, kind), mints (chain, contract, dst).
    """

    def kind(rows: DataFrame, name: str, weight: float, confidence: float) -> DataFrame:
        return rows.select(*KEY, "address").distinct().select(*KEY, "address", F.lit(name).alias("kind"), F.lit(weight).alias("weight"), F.lit(confidence).alias("confidence"))

    sold = sales_of(moves)
    sellers = sold.groupBy(*KEY, F.col("src").alias("address")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    cyclic = components.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    sender, receiver = F.col("src").alias("address"), F.col("dst").alias("address")
    # fixed values: weights and confidences
    parts = [
        kind(held.withColumnRenamed("owner", "address"), "current_holder", 0.5, 0.75),
        kind(moves.select(*KEY, sender), "event_sender", 0.1, 0.25),
        kind(moves.select(*KEY, receiver), "event_recipient", 0.1, 0.25),
        kind(sold.where("usd > 0").select(*KEY, receiver), "paid_acquisition", 0.8, 0.9),
        kind(moves.select(*KEY, sender), "subsequent_propagation", 0.7, 0.8),
        kind(components.join(cyclic, [*KEY, "component"], "left_semi"), "malicious_sale_cycle", 0.9, 0.95),
        kind(sellers, "high_volume_seller", 0.75, 0.85),
        kind(degrees(graph).where("outdegree >= 3"), "star_distributor", 0.8, 0.9),
    ]
    if controllers is not None:
        parts.append(kind(controllers, "controller_or_authority", 1.0, 1.0))
    if deployers is not None:
        parts.append(kind(deployers, "deployment_fee_payer", 1.0, 1.0))
    if mints is not None:
        parts.append(kind(mints.select(*KEY, receiver), "mint_recipient", 0.6, 0.7))
    if flows is not None:
        parts.append(kind(flows.where("kind = 'withdrawal'").select(*KEY, receiver), "withdrawal_recipient", 0.85, 0.95))
        parts.append(kind(flows.where("kind = 'cashout'").select(*KEY, receiver), "cashout_participant", 0.65, 0.8))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wash_cycles(moves: DataFrame, role: DataFrame, least: int = 2) -> DataFrame:
    """chain, contract, component, address: members of components of the sale graph that hold an operator."""
    components = strong_components(edges(sales_of(moves)))
    size = components.join(role, [*KEY, "address"], "left").groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col("role") == "operator", F.lit(False))).alias("bad"))
    return components.join(size.where(F.col("bad") & (F.col("n") >= least)).select(*KEY, "component"), [*KEY, "component"]).select(*KEY, "component", "address")


def cycle_facts(moves: DataFrame, cycles: DataFrame) -> DataFrame:
    """chain, contract, component, addresses, sales, nfts, usd, priced, ended: the sales inside each cycle."""
    a, b = cycles.select(*KEY, F.col("address").alias("src"), F.col("component").alias("component")), cycles.select(*KEY, F.col("address").alias("dst"), F.col("component").alias("other"))
    inside = sales_of(moves).join(a, [*KEY, "src"]).join(b, [*KEY, "dst"]).where("component = other")
    size = cycles.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("addresses"))
    return inside.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("sales"), F.countDistinct("token").alias("nfts"), F.sum("usd").alias("usd"), F.count("usd").alias("priced"), F.max("ts").alias("ended")).join(size, [*KEY, "component"])


def pump_and_exit(moves: DataFrame, role: DataFrame, cycles: DataFrame, facts: DataFrame) -> DataFrame:
    """chain, contract, component, exits, buyers, exit_usd, ratio, delay: cycles whose members sold to victims outside, later and dearer."""
    honest = role.where("role = 'victim'").select(*KEY, F.col("address").alias("dst"))
    seller = cycles.select(*KEY, F.col("address").alias("src"), "component")
    buyer = cycles.select(*KEY, F.col("address").alias("dst"), F.col("component").alias("other"))
    out = sales_of(moves).join(seller, [*KEY, "src"]).join(honest, [*KEY, "dst"], "left_semi").join(buyer, [*KEY, "dst"], "left").where("other IS NULL OR other != component")
    exits = out.join(facts.select(*KEY, "component", "ended"), [*KEY, "component"]).where("ts > ended")
    sums = exits.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("exits"), F.countDistinct("dst").alias("buyers"), F.sum("usd").alias("exit_usd"), F.count("usd").alias("exit_priced"), F.min(F.col("ts") - F.col("ended")).alias("delay"))
    both = sums.join(facts, [*KEY, "component"]).where("priced = sales AND exit_priced = exits").withColumn("ratio", F.try_divide(F.col("exit_usd") / F.col("exits"), F.col("usd") / F.col("sales")))
    return both.where("exit_usd / exits > usd / sales").select(*KEY, "component", "exits", "buyers", F.round("exit_usd", 4).alias("exit_usd"), F.round("ratio", 6).alias("ratio"), "delay")


def star_behaviors(moves: DataFrame, role: DataFrame, fan_out: int = 3) -> DataFrame:
    """chain, contract, component, fan_out, kind: components with an operator and enough targets in the condensed graph.

    The graph's vertices are those of transfers; sales count between them. Any target with targets of its own: sybil; else a sale of
    value goes out: fraud; else poisoning.
    """
    graph = edges(transfers_of(moves))
    components = strong_components(graph)
    vertices = components.select(*KEY, "address")
    both = edges(moves).join(vertices.withColumnRenamed("address", "src"), [*KEY, "src"], "left_semi").join(vertices.withColumnRenamed("address", "dst"), [*KEY, "dst"], "left_semi")
    targets = condensed(both, components)
    bad = components.join(role.where("role = 'operator'"), [*KEY, "address"], "left_semi").select(*KEY, "component").distinct()
    onward = targets.select(*KEY, F.col("component").alias("target")).distinct().withColumn("onward", F.lit(True))
    valued = condensed(edges(sales_of(moves).where("usd > 0")), components).select(*KEY, "component").distinct().withColumn("valued", F.lit(True))
    found = targets.join(onward, [*KEY, "target"], "left").groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("fan_out"), F.max(F.coalesce("onward", F.lit(False))).alias("onward")).where(F.col("fan_out") >= fan_out)
    return found.join(bad, [*KEY, "component"], "left_semi").join(valued, [*KEY, "component"], "left").select(*KEY, "component", "fan_out", F.when(F.col("onward"), "sybil_distribution").when(F.col("valued"), "fraud_revenue").otherwise("poisoning").alias("kind"))


def layered(moves: DataFrame, role: DataFrame) -> DataFrame:
    """chain, contract, token, start, middle, end, path_length, low_value_hops: layers of three addresses from every operator."""
    found = layered_paths(moves, role.where("role = 'operator'"))
    return found.select(*KEY, "token", "start", F.col("path")[1].alias("middle"), F.col("path")[2].alias("end"), "path_length", "low_value_hops")


def inventory(moves: DataFrame, role: DataFrame, least: int = 3) -> DataFrame:
    """chain, contract, address, sources, nfts, nft_share, value_share: operators that gather from many addresses."""
    busy = degrees(edges(transfers_of(moves))).where(F.col("indegree") >= least).join(role.where("role = 'operator'"), [*KEY, "address"], "left_semi").select(*KEY, "address")
    total = moves.groupBy(*KEY).agg(F.countDistinct("token").alias("all_nfts"), F.sum(F.greatest(F.coalesce("usd", F.lit(0.0)), F.lit(0.0))).alias("all_usd"), F.min(F.when(F.col("is_sale"), F.col("usd").isNotNull()).otherwise(F.lit(True))).alias("priced"))
    own = moves.join(busy.withColumnRenamed("address", "dst"), [*KEY, "dst"], "left_semi").groupBy(*KEY, F.col("dst").alias("address")).agg(F.countDistinct("src").alias("sources"), F.countDistinct("token").alias("nfts"), F.sum(F.coalesce("usd", F.lit(0.0))).alias("usd"))
    return own.join(total, KEY).select(*KEY, "address", "sources", "nfts", F.round(F.col("nfts") / F.col("all_nfts"), 6).alias("nft_share"), F.when(F.col("priced") & (F.col("all_usd") > 0), F.round(F.col("usd") / F.col("all_usd"), 6)).alias("value_share"))


def gini(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, gini: 2 sum(i x_i) / (n sum x) - (n + 1) / n over ascending values; null where they sum to 0."""
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("i") * F.col(value)).cast("double").alias("w"), F.sum(value).cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    return sums.select(*keys, F.when(F.col("s") != 0, F.round(2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n"), 6)).alias("gini"))


def top_share(rows: DataFrame, value: str, fraction: float = 0.10) -> DataFrame:
    """top_n, total, top_total, share: what the largest ceil(fraction n) rows hold of the whole.

    The rows are sorted over all partitions by range, and only the number of rows goes to the driver.
    """
    n = rows.count()
    top_n = -(-int(round(fraction * n * 1_000_000)) // 1_000_000)
    top = rows.orderBy(F.col(value).desc_nulls_last()).limit(top_n).agg(F.sum(value).cast("double").alias("top_total"))
    total = rows.agg(F.sum(value).cast("double").alias("total"))
    return total.crossJoin(top).select(F.lit(top_n).cast("long").alias("top_n"), F.round("total", 4).alias("total"), F.round("top_total", 4).alias("top_total"), F.round(F.try_divide("top_total", "total"), 6).alias("share"))
