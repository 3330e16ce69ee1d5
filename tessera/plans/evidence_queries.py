"""Queries of predicates, equi-joins, evidence, costs and report helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import behavior, economics, evidence, snapshot, uri
from tessera.plans import behavior_queries as BQ
from tessera.plans import dedup_queries as DQ
from tessera.plans.registry import query
from tessera.sources.fixtures import MOVES_SQL, NFT_SQL, moves, nft, table

N = "WITH " + NFT_SQL
M = "WITH RECURSIVE " + MOVES_SQL


@query("p4_eligible_metadata", "SELECT doc_id, length(trim(text)) > 0 AND strlen(text) <= 4096 AS eligible FROM documents")
def eligible_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", ((F.length(F.trim("text")) > 0) & (F.octet_length("text") <= 4096)).alias("eligible"))


ZERO = "0x" + "0" * 40


@query("p9_edge_scopes", N + " SELECT a.chain, CASE WHEN b.chain = a.chain THEN 'intra' ELSE 'cross' END AS scope, count(*) AS edges FROM (SELECT DISTINCT chain, contract, token_uri FROM nft) a JOIN (SELECT DISTINCT chain, contract, token_uri FROM nft) b ON a.token_uri = b.token_uri AND (a.chain <> b.chain OR a.contract <> b.contract) GROUP BY 1, 2")
def edge_scopes(spark: SparkSession, folder: str) -> DataFrame:
    # edges of a URI are counted from its contracts by chain, without forming them
    rows = uri.postings(nft(spark, folder), "token_uri")
    by_chain = rows.groupBy("uri", "chain").agg(F.count(F.lit(1)).alias("k"))
    size = by_chain.groupBy("uri").agg(F.sum("k").alias("n"))
    own = by_chain.join(size, "uri").select("chain", F.explode(F.array(F.struct(F.lit("intra").alias("scope"), (F.col("k") * (F.col("k") - 1)).alias("edges")), F.struct(F.lit("cross").alias("scope"), (F.col("k") * (F.col("n") - F.col("k"))).alias("edges")))).alias("s"))
    return own.groupBy("chain", "s.scope").agg(F.sum("s.edges").alias("edges")).where("edges > 0")


@query("j1_uri_groups", N + " SELECT token_uri, count(DISTINCT chain || contract) AS contracts, count(DISTINCT chain) AS chains, count(*) AS nfts FROM nft GROUP BY 1 HAVING count(DISTINCT chain || contract) > 1")
def uri_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = uri.postings(nft(spark, folder), "token_uri")
    return rows.groupBy(F.col("uri").alias("token_uri")).agg(F.count(F.lit(1)).alias("contracts"), F.countDistinct("chain").alias("chains"), F.sum("nfts").alias("nfts")).where("contracts > 1")


@query("j3_left_anti", N + DQ.SEEDS_SQL + " SELECT n.chain, n.contract, count(*) AS nfts FROM nft n LEFT JOIN seeds ON seed_chain = chain AND seed_contract = contract WHERE seed_chain IS NULL GROUP BY ALL")
def left_anti(spark: SparkSession, folder: str) -> DataFrame:
    return nft(spark, folder).join(DQ.seeds(spark, folder), ["chain", "contract"], "left_anti").groupBy("chain", "contract").agg(F.count(F.lit(1)).alias("nfts"))


@query("j5_payload_lookup", N + " SELECT row_order, length(body) AS chars FROM nft WHERE token_uri IN (SELECT token_uri FROM nft GROUP BY 1 HAVING count(*) > 1)")
def payload_lookup(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder)
    ids = own.join(own.groupBy("token_uri").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token_uri"), "token_uri", "left_semi").select("row_order")
    return own.select("row_order", "body").join(ids, "row_order").select("row_order", F.length("body").cast("long").alias("chars"))


@query("j16_price_lookup", M + BQ.PRICES_SQL + " SELECT event_id, usd / rate AS native FROM sales JOIN prices USING (chain)")
def price_lookup(spark: SparkSession, folder: str) -> DataFrame:
    prices = spark.createDataFrame([("ethereum", "ETH", 1, 2000.0), ("ethereum", "ETH", 2, 9.0), ("base", "ETH", 1, 2000.0), ("polygon", "POL", 1, 0.5), ("solana", "SOL", 1, 150.0)], "chain string, symbol string, place int, rate double")
    first = prices.where(economics.chain_native(F.col("chain"), F.col("symbol")) & (F.col("rate") > 0)).groupBy("chain").agg(F.min_by("rate", "place").alias("rate"))
    # at most one row a chain
    return behavior.sales_of(moves(spark, folder)).join(F.broadcast(first), "chain").select("event_id", (F.col("usd") / F.col("rate")).alias("native"))


@query("w11_sorted_postings", N + " SELECT chain, contract, row_number() OVER (PARTITION BY chain ORDER BY contract) AS place FROM (SELECT DISTINCT chain, contract FROM nft)")
def sorted_postings(spark: SparkSession, folder: str) -> DataFrame:
    """A chain's contracts in order, a row each: no list grows with the chain, and a sort that does not fit memory spills."""
    own = nft(spark, folder).select("chain", "contract").distinct()
    return own.select("chain", "contract", F.row_number().over(Window.partitionBy("chain").orderBy("contract")).cast("long").alias("place"))


@query("f3_normalize_text", "SELECT p_partkey, lower(p_name) AS name FROM part")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", T.normalize_text(F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("\n"))).alias("name"))


@query("f11_identities", "SELECT c_custkey, sha256('base:' || lower(c_name)) AS id FROM customer")
def identities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", F.sha2(F.concat(F.lit("base:"), F.lower("c_name")).cast("binary"), 256).alias("id"))


@query("f17_build_metadata", "SELECT p_partkey, '{\"name\":\"' || p_brand || '\"' || CASE WHEN p_partkey % 2 = 0 THEN ',\"image\":\"i\"' ELSE '' END || '}' AS metadata FROM part")
def build_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", evidence.build_metadata(F.col("p_brand"), F.lit(""), F.lit(None).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit("i"))).alias("metadata"))


@query("f18_formats", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, printf('%.2f', p_size * 1.0) || '%' AS percent FROM part")
def formats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", evidence.slug(F.concat(F.lit(" "), "p_name", F.lit("! "))).alias("slug"), evidence.percent(F.col("p_size") / 100).alias("percent"))


@query("d21_prefilter_terms", "SELECT p_partkey, array_to_string(list_sort(list_distinct(['name', 'description', 'attributes', 'trait_type', lower(p_brand), lower(p_type)])), '|') AS terms FROM part")
def prefilter_terms(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.to_json(F.struct(F.lit("x").alias("Name"), F.col("p_brand").alias("description"), F.array(F.struct(F.col("p_type").alias("trait_type"), F.lit(1).alias("value"))).alias("attributes")))
    return table(spark, folder, "part").select("p_partkey", F.array_join(evidence.prefilter_terms(raw), "|").alias("terms"))


@query("e11_mint_payments", M + ", mints AS (SELECT event_id, chain, contract, CAST(event_id // 4 AS VARCHAR) AS tx, dst FROM moves WHERE NOT is_sale), p AS (SELECT chain, CAST(event_id // 4 AS VARCHAR) AS tx, src AS payer, max(usd) AS paid FROM sales GROUP BY ALL) SELECT event_id, paid FROM mints LEFT JOIN p ON p.chain = mints.chain AND p.tx = mints.tx AND p.payer = mints.dst")
def mint_payments(spark: SparkSession, folder: str) -> DataFrame:
    m = moves(spark, folder).withColumn("tx", F.expr("cast(event_id div 4 as string)"))
    return evidence.attach_mint_payments(behavior.transfers_of(m).select("event_id", "chain", "contract", "tx", "dst"), behavior.sales_of(m).select("chain", "tx", "src", "dst", "usd")).select("event_id", "paid")


STATUS = "element_at(array('complete', 'empty', 'truncated', 'failed'), cast({} % 4 as int) + 1)"


@query("e14_cost_stages", M + ", x AS (SELECT chain, contract, (['funding', 'sale_payment', 'cashout_hop', 'other'])[CAST(event_id % 4 AS INT) + 1] AS channel, src, coalesce(usd, 1.0) AS gas FROM moves) SELECT x.chain, x.contract, CASE channel WHEN 'funding' THEN 'setup' WHEN 'sale_payment' THEN 'lure' ELSE 'exit' END AS stage, count(*) AS edges, round(sum(gas), 4) AS gas FROM x JOIN roles r ON r.chain = x.chain AND r.contract = x.contract AND r.address = src WHERE role = 'operator' AND channel <> 'other' GROUP BY 1, 2, 3")
def cost_stages(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = BQ.parts(spark, folder)
    edges = m.selectExpr("chain", "contract", "element_at(array('funding', 'sale_payment', 'cashout_hop', 'other'), cast(event_id % 4 as int) + 1) AS channel", "src", "coalesce(usd, 1.0D) AS gas")
    return evidence.cost_stages(edges.withColumn("payer", F.lit(None).cast("long")), role.where("role = 'victim'"))


@query("e15_stuck", M + f", b AS (SELECT chain, contract, token, dst, max(ts) AS ts, arg_max(usd, (ts, event_id)) AS usd FROM sales GROUP BY ALL) SELECT h.chain, h.contract, count(*) AS tokens, round(sum(usd), 4) AS paid, round(avg({BQ.NOW} - ts), 2) AS mean_seconds FROM holders h JOIN b ON b.chain = h.chain AND b.contract = h.contract AND b.token = h.token AND b.dst = h.owner GROUP BY ALL")
def stuck(spark: SparkSession, folder: str) -> DataFrame:
    m = moves(spark, folder)
    return evidence.stuck_time(behavior.holders(m), behavior.sales_of(m), BQ.NOW)


@query("e19_lifecycle_metrics", M + ", f AS (SELECT chain, contract, min(ts) AS a, min(ts) FILTER (is_sale) AS s FROM moves GROUP BY ALL) SELECT m.chain, m.contract, count(*) FILTER (m.ts < f.s) AS before_sale, count(DISTINCT m.src) AS senders, any_value(f.s - f.a) AS to_sale FROM moves m JOIN f ON f.chain = m.chain AND f.contract = m.contract GROUP BY ALL")
def lifecycle_metrics(spark: SparkSession, folder: str) -> DataFrame:
    m = moves(spark, folder)
    f = m.groupBy("chain", "contract").agg(F.min("ts").alias("a"), F.min(F.when(F.col("is_sale"), F.col("ts"))).alias("s"))
    return m.join(f, ["chain", "contract"]).groupBy("chain", "contract").agg(F.count(F.when(F.col("ts") < F.col("s"), 1)).alias("before_sale"), F.countDistinct("src").alias("senders"), F.first(F.col("s") - F.col("a")).alias("to_sale"))


@query("e23_projected_facts", N + DQ.SEED_URI_SQL + ", g AS (SELECT chain, contract, count(*) AS all_nfts FROM nft GROUP BY ALL), h AS (SELECT DISTINCT seed_chain, seed_contract, chain, contract FROM su) SELECT seed_chain, seed_contract, CAST(sum(all_nfts) AS BIGINT) AS nfts, count(*) AS candidates FROM h JOIN g USING (chain, contract) GROUP BY ALL")
def projected_facts(spark: SparkSession, folder: str) -> DataFrame:
    facts = nft(spark, folder).groupBy("chain", "contract").agg(F.count(F.lit(1)).alias("all_nfts"))
    hits = DQ.seed_uri(spark, folder).select("seed_chain", "seed_contract", "chain", "contract").distinct()
    return hits.join(facts, ["chain", "contract"]).groupBy("seed_chain", "seed_contract").agg(F.sum("all_nfts").alias("nfts"), F.count(F.lit(1)).alias("candidates"))


@query("s13_cached_table", N + " SELECT chain, count(*) AS nfts FROM nft GROUP BY chain")
def cached_table(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.cached(spark, "totals", {"version": 1, "app": spark.sparkContext.applicationId}, [f"{folder}/documents.parquet"], lambda: nft(spark, folder).groupBy("chain").agg(F.count(F.lit(1)).alias("nfts")))


@query("s10_valid_rows", N + " SELECT count(*) AS rows FROM nft WHERE trim(chain) <> '' AND trim(contract) <> '' AND trim(token_id) <> ''")
def valid_rows(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.normalised(nft(spark, folder)).agg(F.count(F.lit(1)).alias("rows"))
