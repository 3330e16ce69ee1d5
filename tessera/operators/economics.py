"""Lifecycle, value flow and economics of contracts, and legitimacy of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.behavior import sales_of, transfers_of, victims
from tessera.operators.graphs import KEY

# Symbols of payment tokens.
ETH_LIKE = ("ETH", "WETH")
STABLECOINS = ("USDC", "USDT", "DAI", "USDS", "USDE", "FDUSD", "TUSD", "PYUSD", "GUSD", "USDP", "LUSD", "SUSD", "FRAX")
NATIVE = {"ethereum": ("ETH", "WETH"), "base": ("ETH", "WETH"), "polygon": ("POL", "WPOL", "MATIC", "WMATIC"), "solana": ("SOL", "WSOL")}


def symbol_key(c: Column) -> Column:
    return F.upper(F.trim(c))


def chain_native(chain: Column, symbol: Column) -> Column:
    out = F.lit(False)
    for name, symbols in NATIVE.items():
        out = F.when(F.lower(F.trim(chain)) == name, symbol_key(symbol).isin(*symbols)).otherwise(out)
    return out


def to_native_and_usd(chain: Column, amount: Column, symbol: Column, rate: Column) -> Column:
    """struct(native, usd) of an amount: stablecoins at one dollar, the chain's own coin at the rate; null for others."""
    usable = amount.isNotNull() & ~F.isnan(amount) & (amount >= 0) & (amount < float("inf"))
    good = F.when((rate > 0) & (rate < float("inf")), rate)
    native, stable = chain_native(chain, symbol), symbol_key(symbol).isin(*STABLECOINS)
    return F.struct(F.when(usable & native, amount).when(usable & stable, amount / good).alias("native"), F.when(usable & native, amount * good).when(usable & stable, amount).alias("usd"))


def lifecycle(moves: DataFrame, held: DataFrame, now: int) -> DataFrame:
    """chain, contract and its first times, delays, and how long the first victim has held."""
    first = moves.groupBy(*KEY).agg(F.min("ts").alias("first_activity"), F.min(F.when(~F.col("is_sale"), F.col("ts"))).alias("first_transfer"), F.min(F.when(F.col("is_sale"), F.col("ts"))).alias("first_sale"))
    v = victims(moves, held).select(*KEY, "token", F.col("address").alias("dst"))
    bought = sales_of(moves).where("usd > 0").join(v, [*KEY, "token", "dst"], "left_semi")
    earliest = bought.groupBy(*KEY).agg(F.min(F.struct("ts", "event_id", "token", "dst")).alias("a")).select(*KEY, F.col("a.ts").alias("acquired"), F.col("a.token").alias("token"), F.col("a.dst").alias("src"))
    left = moves.select(*KEY, "token", "src", "ts").join(earliest, [*KEY, "token", "src"]).where("ts > acquired").groupBy(*KEY).agg(F.min("ts").alias("disposed"))
    return first.join(earliest.select(*KEY, "acquired"), KEY, "left").join(left, KEY, "left").select(*KEY, "first_activity", "first_transfer", "first_sale", F.col("acquired").alias("first_victim"), (F.col("acquired") - F.col("first_activity")).alias("to_first_victim"), (F.coalesce("disposed", F.lit(now)) - F.col("acquired")).alias("holding_seconds"))


def value_flow(moves: DataFrame, role: DataFrame) -> DataFrame:
    """chain, contract: addresses, edges, revenue, and the operator that received most."""
    size = moves.groupBy(*KEY).agg(F.countDistinct("token").alias("nfts"), F.sum(F.when(F.col("is_sale"), 0).otherwise(1)).alias("transfers"), F.sum(F.when(F.col("is_sale"), 1).otherwise(0)).alias("sales"), F.round(F.sum(F.greatest(F.coalesce("usd", F.lit(0.0)), F.lit(0.0))), 4).alias("gross_usd"))
    people = role.groupBy(*KEY).agg(F.sum(F.when(F.col("role") == "operator", 1).otherwise(0)).alias("operators"), F.sum(F.when(F.col("role") == "victim", 1).otherwise(0)).alias("victims"))
    paid = sales_of(moves).join(role.where("role = 'operator'").select(*KEY, F.col("address").alias("src")), [*KEY, "src"], "left_semi").groupBy(*KEY, "src").agg(F.round(F.sum(F.coalesce("usd", F.lit(0.0))), 4).alias("usd"))
    most = paid.groupBy(*KEY).agg(F.min(F.struct((-F.col("usd")).alias("less"), F.col("src"))).alias("m"), F.sum("usd").alias("total")).select(*KEY, F.col("m.src").alias("top_receiver"), (-F.col("m.less")).alias("top_usd"), F.round(F.try_divide(-F.col("m.less"), F.col("total")), 6).alias("top_share"))
    return size.join(people, KEY, "left").join(most, KEY, "left").select(*KEY, "nfts", "transfers", "sales", "gross_usd", "operators", "victims", "top_receiver", "top_usd", "top_share")


def exposure(moves: DataFrame, role: DataFrame, held: DataFrame) -> DataFrame:
    """chain, contract: operators' output, and what victims paid for tokens that they still hold."""
    sold = sales_of(moves).join(role.where("role = 'operator'").select(*KEY, F.col("address").alias("src")), [*KEY, "src"], "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("operator_sales"), F.round(F.sum(F.coalesce("usd", F.lit(0.0))), 4).alias("operator_output_usd"))
    v = victims(moves, held).select(*KEY, "token", F.col("address").alias("dst"))
    lost = sales_of(moves).where("usd > 0").join(v, [*KEY, "token", "dst"], "left_semi").groupBy(*KEY).agg(F.round(F.sum("usd"), 4).alias("honest_loss_usd"), F.countDistinct("token").alias("stuck_nfts"))
    return moves.select(*KEY).distinct().join(sold, KEY, "left").join(lost, KEY, "left").select(*KEY, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("operator_sales", "operator_output_usd", "honest_loss_usd", "stuck_nfts")))


def money_sum(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, events, usd: sums in which an event reported twice counts once.

    An event is its keys, token, tx, ends, kind and exact amount; one without a tx is always its own.
    """
    own = [*keys, "token", "tx", "src", "dst", "kind", "usd"]
    known = rows.where(F.coalesce("tx", F.lit("")) != "").dropDuplicates(own)
    return known.select(own).unionByName(rows.where(F.coalesce("tx", F.lit("")) == "").select(own)).groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("usd"), 4).alias("usd"))


def gas_stages(rows: DataFrame) -> DataFrame:
    """chain, contract, stage, txs, gas: each transaction's largest gas, at its highest stage; a funding makes it setup."""
    order = F.when(F.col("stage") == "setup", 0).when(F.col("stage") == "lure", 1).otherwise(2)
    one = rows.groupBy(*KEY, "tx").agg(F.max("gas").alias("gas"), F.max(order).alias("o"), F.max(F.col("funding")).alias("funding"))
    name = F.when(F.col("funding") | (F.col("o") == 0), "setup").when(F.col("o") == 1, "lure").otherwise("exit")
    return one.groupBy(*KEY, name.alias("stage")).agg(F.count(F.lit(1)).alias("txs"), F.round(F.sum("gas"), 4).alias("gas"))


def gas_sums(rows: DataFrame) -> DataFrame:
    """chain, contract, gas, gas_setup, gas_lure, gas_exit, funding_txs: as ``gas_stages``, a row a contract, unrounded."""
    order = F.when(F.col("stage") == "setup", 0).when(F.col("stage") == "lure", 1).otherwise(2)
    one = rows.groupBy(*KEY, "tx").agg(F.max("gas").alias("gas"), F.max(order).alias("o"), F.max(F.col("funding")).alias("funding"))
    stage = F.when(F.col("funding"), 0).otherwise(F.col("o"))
    return one.groupBy(*KEY).agg(F.sum("gas").alias("gas"), *(F.sum(F.when(stage == i, F.col("gas"))).alias(f"gas_{n}") for i, n in enumerate(("setup", "lure", "exit"))), F.count(F.when(F.col("funding"), 1)).alias("funding_txs"))


def exposure_exact(moves: DataFrame, role: DataFrame, held: DataFrame) -> DataFrame:
    """chain, contract, output, loss, stuck: what operators took, what holders paid, and the tokens that they hold; unrounded."""
    sales = moves.where("is_sale")
    took = sales.join(role.where("role = 'operator'").select(*KEY, F.col("address").alias("src")), [*KEY, "src"], "left_semi").groupBy(*KEY).agg(F.sum("usd").alias("output"))
    paid = sales.where("usd > 0").join(held.withColumnRenamed("owner", "dst"), [*KEY, "token", "dst"], "left_semi").groupBy(*KEY).agg(F.sum("usd").alias("loss"), F.countDistinct("token").alias("stuck"))
    return took.join(paid, KEY, "full")


def classify_flow(flows: DataFrame, operators: DataFrame, contracts: DataFrame) -> DataFrame:
    """flows (src, dst, ...) with kind: operator to contract is funding, contract to operator withdrawal, else to operator backflow."""
    o, c = operators.select("address").distinct(), contracts.select("address").distinct()
    flagged = (
        flows.join(o.select(F.col("address").alias("src"), F.lit(True).alias("src_op")), "src", "left")
        .join(o.select(F.col("address").alias("dst"), F.lit(True).alias("dst_op")), "dst", "left")
        .join(c.select(F.col("address").alias("src"), F.lit(True).alias("src_c")), "src", "left")
        .join(c.select(F.col("address").alias("dst"), F.lit(True).alias("dst_c")), "dst", "left")
    )
    kind = F.when(F.col("src_op") & F.col("dst_c"), "funding").when(F.col("src_c") & F.col("dst_op"), "withdrawal").when(F.col("dst_op"), "revenue_backflow")
    return flagged.withColumn("kind", kind).where("kind IS NOT NULL").drop("src_op", "dst_op", "src_c", "dst_c")


def activity_window(moves: DataFrame, margin: int) -> DataFrame:
    """chain, contract, lowest, highest: the span of blocks with activity, widened on both sides, from block 0 on."""
    return moves.groupBy(*KEY).agg(F.greatest(F.min("block") - margin, F.lit(0)).alias("lowest"), (F.max("block") + margin).alias("highest"))


def legitimate(signals: DataFrame, flags: list[str]) -> DataFrame:
    """chain, contract, legit_relations, suspicious_relations, state: a relation is legit if any signal is; a contract if all its relations are."""
    any_flag = F.lit(False)
    for f in flags:
        any_flag = any_flag | F.coalesce(F.col(f), F.lit(False))
    own = signals.withColumn("legit", any_flag).groupBy(*KEY).agg(F.sum(F.when(F.col("legit"), 1).otherwise(0)).alias("legit_relations"), F.sum(F.when(F.col("legit"), 0).otherwise(1)).alias("suspicious_relations"))
    return own.withColumn("state", F.when(F.col("suspicious_relations") > 0, "suspected").otherwise("legitimate"))


def lifecycle_stages(moves: DataFrame) -> DataFrame:
    """chain, contract, stage, started, next_stage, seconds: ordered stages and the time to the next."""
    stages = moves.groupBy(*KEY).agg(F.min("ts").alias("a"), F.min(F.when(~F.col("is_sale"), F.col("ts"))).alias("b"), F.min(F.when(F.col("is_sale"), F.col("ts"))).alias("c"), F.max("ts").alias("d"))
    long = stages.select(*KEY, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("stage"), F.col(c).alias("started")) for i, (n, c) in enumerate((("activity", "a"), ("spread", "b"), ("sale", "c"), ("last", "d")))))).alias("s")).select(*KEY, "s.*").where("started IS NOT NULL")
    w = Window.partitionBy(*KEY).orderBy("started", "i")
    return long.select(*KEY, "stage", "started", F.lead("stage").over(w).alias("next_stage"), (F.lead("started").over(w) - F.col("started")).alias("seconds"))


def propagation(moves: DataFrame) -> DataFrame:
    """chain, contract, src, dst, moves, sales, nfts, usd, first_ts, last_ts: aggregated edges of spread."""
    return moves.groupBy(*KEY, "src", "dst").agg(F.count(F.lit(1)).alias("moves"), F.sum(F.when(F.col("is_sale"), 1).otherwise(0)).alias("sales"), F.countDistinct("token").alias("nfts"), F.round(F.sum(F.coalesce("usd", F.lit(0.0))), 4).alias("usd"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merged_moves(sales: DataFrame, transfers: DataFrame) -> DataFrame:
    """One edge a move: a sale and a transfer of the same transaction, token and ends are one."""
    key = [*KEY, "tx", "token", "src", "dst"]
    s, t = sales.select(*key, F.col("usd")).dropDuplicates(key), transfers.select(*key).distinct().withColumn("t", F.lit(True))
    return s.withColumn("s", F.lit(True)).join(t, key, "full").select(*key, F.coalesce("s", F.lit(False)).alias("is_sale"), F.coalesce("t", F.lit(False)).alias("is_transfer"), "usd")


def transfers_between(moves: DataFrame) -> DataFrame:
    return transfers_of(moves)
