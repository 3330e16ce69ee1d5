"""Queries of graphs, behaviour and economics over the ``moves`` view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import behavior, economics, graphs
from tessera.plans.registry import query
from tessera.runtime import materialise
from tessera.sources.fixtures import MOVES_SQL, moves, table

W = "WITH RECURSIVE " + MOVES_SQL
#: Strongly connected components by reachability both ways.
SCC_SQL = """, {p}e AS (SELECT DISTINCT chain, contract, src, dst FROM {t}),
{p}r AS (SELECT chain, contract, src AS a, dst AS b FROM {p}e UNION SELECT r.chain, r.contract, r.a, e.dst FROM {p}r r JOIN {p}e e ON e.chain = r.chain AND e.contract = r.contract AND e.src = r.b),
{p}v AS (SELECT chain, contract, src AS address FROM {p}e UNION SELECT chain, contract, dst FROM {p}e),
{p}scc AS (SELECT v.chain, v.contract, v.address, least(v.address, coalesce(min(f.b), v.address)) AS component FROM {p}v v
  LEFT JOIN ({p}r f JOIN {p}r g ON g.chain = f.chain AND g.contract = f.contract AND g.a = f.b AND g.b = f.a) ON f.chain = v.chain AND f.contract = v.contract AND f.a = v.address
  GROUP BY v.chain, v.contract, v.address)"""
SALE_SCC = SCC_SQL.format(p="s", t="sales")
WASH_SQL = SALE_SCC + """, wash AS (SELECT chain, contract, component, address FROM sscc WHERE (chain, contract, component) IN (
  SELECT (c.chain, c.contract, c.component) FROM sscc c JOIN roles r ON r.chain = c.chain AND r.contract = c.contract AND r.address = c.address
  GROUP BY c.chain, c.contract, c.component HAVING count(*) >= 2 AND bool_or(r.role = 'operator')))"""
FACTS_SQL = WASH_SQL + """, facts AS (SELECT s.chain, s.contract, a.component, count(*) AS sales, count(DISTINCT token) AS nfts, sum(usd) AS usd, max(ts) AS ended FROM sales s
  JOIN wash a ON a.chain = s.chain AND a.contract = s.contract AND a.address = s.src JOIN wash b ON b.chain = s.chain AND b.contract = s.contract AND b.address = s.dst AND a.component = b.component GROUP BY ALL)"""


def parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """moves, holders, roles. The moves are written once: several branches of a plan read them."""
    m = materialise(moves(spark, folder), "moves")
    held = behavior.holders(m)
    return m, held, behavior.roles(m, held)


@query("g1_address_graph", W + " SELECT DISTINCT chain, contract, src, dst FROM moves")
def address_graph(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.edges(moves(spark, folder))


@query("g2_strong_components", W + SALE_SCC + " SELECT chain, contract, address, component FROM sscc")
def strong_components(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.strong_components(graphs.edges(behavior.sales_of(moves(spark, folder))))


@query("g3_condensed_targets", W + SALE_SCC + " SELECT DISTINCT e.chain, e.contract, a.component, b.component AS target FROM se e JOIN sscc a ON a.chain = e.chain AND a.contract = e.contract AND a.address = e.src JOIN sscc b ON b.chain = e.chain AND b.contract = e.contract AND b.address = e.dst WHERE a.component <> b.component")
def condensed_targets(spark: SparkSession, folder: str) -> DataFrame:
    graph = materialise(graphs.edges(behavior.sales_of(moves(spark, folder))), "sale-edges")
    return graphs.condensed(graph, graphs.strong_components(graph))


@query("g4_degrees", W + " SELECT chain, contract, address, CAST(sum(i) AS BIGINT) AS indegree, CAST(sum(o) AS BIGINT) AS outdegree FROM (SELECT DISTINCT chain, contract, src, dst, src AS address, 0 AS i, 1 AS o FROM moves UNION ALL SELECT DISTINCT chain, contract, src, dst, dst, 1, 0 FROM moves) GROUP BY chain, contract, address")
def degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.degrees(graphs.edges(moves(spark, folder)))


LOW_SQL = "CASE WHEN NOT {0}.is_sale OR coalesce({0}.usd BETWEEN 0 AND 1, false) THEN 1 ELSE 0 END"


@query("g5_layered_paths", W + f""", p AS (SELECT a.chain, a.contract, a.token, a.src AS start, a.dst AS middle, b.dst AS "end", {LOW_SQL.format('a')} + {LOW_SQL.format('b')} AS low_value_hops, row_number() OVER (PARTITION BY a.chain, a.contract, a.token, a.src ORDER BY a.ts, a.event_id, b.ts, b.event_id) AS rn
  FROM moves a JOIN moves b ON a.chain = b.chain AND a.contract = b.contract AND a.token = b.token AND a.dst = b.src AND b.ts > a.ts AND b.dst <> a.src
  JOIN roles r ON r.chain = a.chain AND r.contract = a.contract AND r.address = a.src AND r.role = 'operator') SELECT chain, contract, token, start, middle, "end", 3 AS path_length, low_value_hops FROM p WHERE rn = 1""")
def layered_paths(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = parts(spark, folder)
    return behavior.layered(m, role)


@query("b4_long_layers", W + f""", p AS (SELECT a.chain, a.contract, a.token, a.src AS start, a.dst || '>' || b.dst || '>' || c.dst AS rest, {LOW_SQL.format('a')} + {LOW_SQL.format('b')} + {LOW_SQL.format('c')} AS low_value_hops, row_number() OVER (PARTITION BY a.chain, a.contract, a.token, a.src ORDER BY a.ts, a.event_id, b.ts, b.event_id, c.ts, c.event_id) AS rn
  FROM moves a JOIN moves b ON a.chain = b.chain AND a.contract = b.contract AND a.token = b.token AND a.dst = b.src AND b.ts > a.ts AND b.dst <> a.src
  JOIN moves c ON c.chain = b.chain AND c.contract = b.contract AND c.token = b.token AND b.dst = c.src AND c.ts > b.ts AND c.dst <> a.src AND c.dst <> a.dst
  JOIN roles r ON r.chain = a.chain AND r.contract = a.contract AND r.address = a.src AND r.role = 'operator') SELECT chain, contract, token, start, rest, low_value_hops FROM p WHERE rn = 1""")
def long_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Layers through four addresses."""
    m, _, role = parts(spark, folder)
    found = graphs.layered_paths(m, role.where("role = 'operator'"), 4)
    return found.select("chain", "contract", "token", "start", F.concat_ws(">", F.transform(F.slice("path", 2, 3), lambda x: x.cast("string"))).alias("rest"), "low_value_hops")


@query("g8_reciprocal_pairs", W + " SELECT a.chain, a.contract, count(*) AS pairs FROM (SELECT DISTINCT chain, contract, src, dst FROM moves) a JOIN (SELECT DISTINCT chain, contract, src, dst FROM moves) b ON a.chain = b.chain AND a.contract = b.contract AND a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst GROUP BY ALL")
def reciprocal_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.reciprocal_pairs(graphs.edges(moves(spark, folder)))


@query("g9_propagation", W + " SELECT chain, contract, src, dst, count(*) AS moves, count(*) FILTER (is_sale) AS sales, count(DISTINCT token) AS nfts, round(sum(coalesce(usd, 0)), 4) AS usd, min(ts) AS first_ts, max(ts) AS last_ts FROM moves GROUP BY ALL")
def propagation(spark: SparkSession, folder: str) -> DataFrame:
    return economics.propagation(moves(spark, folder))


@query("b1_wash_trading", W + WASH_SQL + " SELECT chain, contract, component, address FROM wash")
def wash_trading(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = parts(spark, folder)
    return behavior.wash_cycles(m, role)


@query("a9_cycle_facts", W + FACTS_SQL + " SELECT chain, contract, component, sales, nfts, round(usd, 4) AS usd, ended FROM facts")
def cycle_facts(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = parts(spark, folder)
    return behavior.cycle_facts(m, behavior.wash_cycles(m, role)).select("chain", "contract", "component", "sales", "nfts", F.round("usd", 4).alias("usd"), "ended")


@query("b2_pump_and_exit", W + FACTS_SQL + """, x AS (SELECT f.chain, f.contract, f.component, count(*) AS exits, count(DISTINCT s.dst) AS buyers, sum(s.usd) AS exit_usd, min(s.ts - f.ended) AS delay, any_value(f.usd) AS usd, any_value(f.sales) AS sales
  FROM facts f JOIN wash w ON w.chain = f.chain AND w.contract = f.contract AND w.component = f.component JOIN sales s ON s.chain = f.chain AND s.contract = f.contract AND s.src = w.address AND s.ts > f.ended
  JOIN roles r ON r.chain = s.chain AND r.contract = s.contract AND r.address = s.dst AND r.role = 'victim'
  WHERE NOT EXISTS (SELECT 1 FROM wash o WHERE o.chain = s.chain AND o.contract = s.contract AND o.component = f.component AND o.address = s.dst) GROUP BY f.chain, f.contract, f.component)
  SELECT chain, contract, component, exits, buyers, round(exit_usd, 4) AS exit_usd, round((exit_usd / exits) / (usd / sales), 6) AS ratio, delay FROM x WHERE exit_usd / exits > usd / sales""")
def pump_and_exit(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = parts(spark, folder)
    role = materialise(role, "roles")
    cycles = materialise(behavior.wash_cycles(m, role), "cycles")
    return behavior.pump_and_exit(m, role, cycles, behavior.cycle_facts(m, cycles))


@query("b3_star_distribution", W + ", transfers AS (SELECT * FROM moves WHERE NOT is_sale)" + SCC_SQL.format(p="t", t="transfers") + """,
  de AS (SELECT DISTINCT m.chain, m.contract, a.component, b.component AS target, bool_or(m.is_sale AND m.usd > 0) AS valued FROM moves m JOIN tscc a ON a.chain = m.chain AND a.contract = m.contract AND a.address = m.src JOIN tscc b ON b.chain = m.chain AND b.contract = m.contract AND b.address = m.dst WHERE a.component <> b.component GROUP BY ALL),
  k AS (SELECT d.chain, d.contract, d.component, count(*) AS fan_out, bool_or(EXISTS (SELECT 1 FROM de o WHERE o.chain = d.chain AND o.contract = d.contract AND o.component = d.target)) AS onward, bool_or(valued) AS valued FROM de d GROUP BY ALL)
  SELECT k.chain, k.contract, k.component, fan_out, CASE WHEN onward THEN 'sybil_distribution' WHEN valued THEN 'fraud_revenue' ELSE 'poisoning' END AS kind FROM k
  WHERE fan_out >= 3 AND EXISTS (SELECT 1 FROM tscc c JOIN roles r ON r.chain = c.chain AND r.contract = c.contract AND r.address = c.address AND r.role = 'operator' WHERE c.chain = k.chain AND c.contract = k.contract AND c.component = k.component)""")
def star_distribution(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = parts(spark, folder)
    return behavior.star_behaviors(m, role)


@query("b5_inventory", W + """, t AS (SELECT chain, contract, dst AS address FROM (SELECT DISTINCT chain, contract, src, dst FROM moves WHERE NOT is_sale) GROUP BY ALL HAVING count(*) >= 3),
  a AS (SELECT chain, contract, count(DISTINCT token) AS all_nfts, sum(coalesce(usd, 0)) AS all_usd, bool_and(NOT is_sale OR usd IS NOT NULL) AS priced FROM moves GROUP BY ALL),
  o AS (SELECT m.chain, m.contract, m.dst AS address, count(DISTINCT m.src) AS sources, count(DISTINCT token) AS nfts, sum(coalesce(usd, 0)) AS usd FROM moves m JOIN t ON t.chain = m.chain AND t.contract = m.contract AND t.address = m.dst JOIN roles r ON r.chain = m.chain AND r.contract = m.contract AND r.address = m.dst AND r.role = 'operator' GROUP BY ALL)
  SELECT o.chain, o.contract, address, sources, nfts, round(nfts / all_nfts, 6) AS nft_share, CASE WHEN priced AND all_usd > 0 THEN round(usd / all_usd, 6) END AS value_share FROM o JOIN a ON a.chain = o.chain AND a.contract = o.contract""")
def inventory(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = parts(spark, folder)
    return behavior.inventory(m, role)


@query("b6_behaviour_summary", W + WASH_SQL + " SELECT count(DISTINCT (chain, contract)) AS contracts, count(DISTINCT (chain, contract, component)) AS instances, count(DISTINCT (chain, address)) AS addresses FROM wash")
def behaviour_summary(spark: SparkSession, folder: str) -> DataFrame:
    return wash_trading(spark, folder).agg(F.countDistinct("chain", "contract").alias("contracts"), F.countDistinct("chain", "contract", "component").alias("instances"), F.countDistinct("chain", "address").alias("addresses"))


@query("b7_wash_sizes", W + WASH_SQL + " SELECT CAST(least(n, 5) AS BIGINT) AS participants, count(*) AS cycles FROM (SELECT chain, contract, component, count(*) AS n FROM wash GROUP BY ALL) GROUP BY 1")
def wash_sizes(spark: SparkSession, folder: str) -> DataFrame:
    size = wash_trading(spark, folder).groupBy("chain", "contract", "component").agg(F.count(F.lit(1)).alias("n"))
    return size.groupBy(F.least("n", F.lit(5)).cast("long").alias("participants")).agg(F.count(F.lit(1)).alias("cycles"))


@query("a10_gini", W + ", d AS (SELECT chain, contract, src, count(*) AS n, row_number() OVER (PARTITION BY chain, contract ORDER BY count(*)) AS i FROM moves GROUP BY chain, contract, src) SELECT chain, contract, round(2 * CAST(sum(i * n) AS DOUBLE) / (count(*) * CAST(sum(n) AS DOUBLE)) - (count(*) + 1.0) / count(*), 6) AS gini FROM d GROUP BY ALL")
def gini(spark: SparkSession, folder: str) -> DataFrame:
    return behavior.gini(moves(spark, folder).groupBy("chain", "contract", "src").agg(F.count(F.lit(1)).alias("n")), ["chain", "contract"], "n")


@query("a11_median_holding", W + " SELECT chain, contract, median(s) AS seconds FROM (SELECT chain, contract, lead(ts) OVER (PARTITION BY chain, contract, token ORDER BY ts, event_id) - ts AS s FROM moves) WHERE s IS NOT NULL GROUP BY ALL")
def median_holding(spark: SparkSession, folder: str) -> DataFrame:
    held = moves(spark, folder).selectExpr("chain", "contract", "lead(ts) OVER (PARTITION BY chain, contract, token ORDER BY ts, event_id) - ts AS s").where("s IS NOT NULL")
    return held.groupBy("chain", "contract").agg(F.percentile("s", 0.5).alias("seconds"))


@query("a12_top_share", W + ", c AS (SELECT chain, contract, sum(usd) AS usd FROM sales GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY usd DESC) AS rn, count(*) OVER () AS n FROM c) SELECT CAST(any_value(ceil(0.1 * n)) AS BIGINT) AS top_n, round(sum(usd), 4) AS total, round(sum(usd) FILTER (rn <= ceil(0.1 * n)), 4) AS top_total, round(sum(usd) FILTER (rn <= ceil(0.1 * n)) / sum(usd), 6) AS share FROM r")
def top_share(spark: SparkSession, folder: str) -> DataFrame:
    return behavior.top_share(behavior.sales_of(moves(spark, folder)).groupBy("chain", "contract").agg(F.sum("usd").alias("usd")), "usd")


@query("a13_ratio", W + " SELECT chain, count(*) FILTER (is_sale) AS sales, count(*) AS moves, round(count(*) FILTER (is_sale) / nullif(count(*), 0), 6) AS ratio FROM moves GROUP BY chain")
def ratio(spark: SparkSession, folder: str) -> DataFrame:
    return moves(spark, folder).groupBy("chain").agg(F.count(F.when(F.col("is_sale"), 1)).alias("sales"), F.count(F.lit(1)).alias("moves")).withColumn("ratio", F.round(F.try_divide("sales", "moves"), 6))


GAS_SQL = ", gas AS (SELECT chain, contract, CAST(event_id // 3 AS VARCHAR) AS tx, (['setup', 'lure', 'exit'])[CAST(event_id % 3 AS INT) + 1] AS stage, coalesce(usd, 1.0) AS gas, event_id % 7 = 0 AS funding FROM moves)"


@query("a14_gas_stages", W + GAS_SQL + ", o AS (SELECT chain, contract, tx, max(gas) AS gas, max(CASE stage WHEN 'setup' THEN 0 WHEN 'lure' THEN 1 ELSE 2 END) AS o, bool_or(funding) AS f FROM gas GROUP BY ALL) SELECT chain, contract, CASE WHEN f OR o = 0 THEN 'setup' WHEN o = 1 THEN 'lure' ELSE 'exit' END AS stage, count(*) AS txs, round(sum(gas), 4) AS gas FROM o GROUP BY 1, 2, 3")
def gas_stages(spark: SparkSession, folder: str) -> DataFrame:
    rows = moves(spark, folder).selectExpr("chain", "contract", "cast(event_id div 3 as string) AS tx", "element_at(array('setup', 'lure', 'exit'), cast(event_id % 3 as int) + 1) AS stage", "coalesce(usd, 1.0D) AS gas", "event_id % 7 = 0 AS funding")
    return economics.gas_stages(rows)


@query("a15_money_sums", W + ", m AS (SELECT chain, contract, token, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id // 2 AS VARCHAR) END AS tx, src, dst, 'sale' AS kind, usd FROM sales), d AS (SELECT DISTINCT * FROM m WHERE tx <> '' UNION ALL SELECT * FROM m WHERE tx = '') SELECT chain, contract, count(*) AS events, round(sum(usd), 4) AS usd FROM d GROUP BY ALL")
def money_sums(spark: SparkSession, folder: str) -> DataFrame:
    own = behavior.sales_of(moves(spark, folder)).selectExpr("chain", "contract", "token", "CASE WHEN event_id % 5 = 0 THEN '' ELSE cast(event_id div 2 as string) END AS tx", "src", "dst", "'sale' AS kind", "usd")
    return economics.money_sum(own.unionByName(own.where("tx != ''")), ["chain", "contract"])


@query("a16_bucket_histogram", W + ", n AS (SELECT chain, contract, src, count(DISTINCT dst) AS n FROM moves GROUP BY ALL) SELECT CAST(least(n, 5) AS BIGINT) AS bucket, count(*) AS addresses FROM n WHERE n >= 2 GROUP BY 1")
def bucket_histogram(spark: SparkSession, folder: str) -> DataFrame:
    n = moves(spark, folder).groupBy("chain", "contract", "src").agg(F.countDistinct("dst").alias("n")).where("n >= 2")
    return n.groupBy(F.least("n", F.lit(5)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("addresses"))


@query("a21_status_histogram", "SELECT o_orderpriority AS family, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus = 'O') AS truncated, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1")
def status_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg(*(F.count(F.when(F.col("o_orderstatus") == k, 1)).alias(n) for k, n in (("F", "complete"), ("O", "truncated"), ("P", "failed"))))


@query("e1_victims", W + " SELECT DISTINCT h.chain, h.contract, h.owner AS address, h.token FROM holders h JOIN sales s ON s.chain = h.chain AND s.contract = h.contract AND s.token = h.token AND s.dst = h.owner AND s.usd > 0")
def victims(spark: SparkSession, folder: str) -> DataFrame:
    m, held, _ = parts(spark, folder)
    return behavior.victims(m, held)


@query("e2_roles", W + " SELECT chain, contract, address, role FROM roles")
def roles(spark: SparkSession, folder: str) -> DataFrame:
    return parts(spark, folder)[2]


@query("e3_evidence", W + SALE_SCC + """, x AS (
  SELECT DISTINCT chain, contract, owner AS address, 'current_holder' AS kind, 0.5 AS weight, 0.75 AS confidence FROM holders
  UNION ALL SELECT DISTINCT chain, contract, src, unnest(['event_sender', 'subsequent_propagation']), unnest([0.1, 0.7]), unnest([0.25, 0.8]) FROM moves
  UNION ALL SELECT DISTINCT chain, contract, dst, 'event_recipient', 0.1, 0.25 FROM moves
  UNION ALL SELECT DISTINCT chain, contract, dst, 'paid_acquisition', 0.8, 0.9 FROM sales WHERE usd > 0
  UNION ALL SELECT chain, contract, src, 'high_volume_seller', 0.75, 0.85 FROM sales GROUP BY chain, contract, src HAVING count(*) >= 3
  UNION ALL SELECT chain, contract, src, 'star_distributor', 0.8, 0.9 FROM moves WHERE NOT is_sale GROUP BY chain, contract, src HAVING count(DISTINCT dst) >= 3
  UNION ALL SELECT DISTINCT chain, contract, dst, 'mint_recipient', 0.6, 0.7 FROM (SELECT *, row_number() OVER (PARTITION BY chain, contract, token ORDER BY ts, event_id) AS rn FROM moves) WHERE rn = 1
  UNION ALL SELECT DISTINCT chain, contract, dst, 'withdrawal_recipient', 0.85, 0.95 FROM moves WHERE is_sale AND usd >= 95
  UNION ALL SELECT DISTINCT chain, contract, dst, 'cashout_participant', 0.65, 0.8 FROM moves WHERE is_sale AND usd < 1
  UNION ALL SELECT DISTINCT chain, contract, src, 'controller_or_authority', 1.0, 1.0 FROM moves WHERE src < 3
  UNION ALL SELECT DISTINCT chain, contract, src, 'deployment_fee_payer', 1.0, 1.0 FROM moves WHERE src = 7
  UNION ALL SELECT chain, contract, address, 'malicious_sale_cycle', 0.9, 0.95 FROM sscc WHERE (chain, contract, component) IN (SELECT (chain, contract, component) FROM sscc GROUP BY chain, contract, component HAVING count(*) >= 2))
  SELECT chain, contract, address, kind, CAST(weight AS DOUBLE) AS weight, CAST(confidence AS DOUBLE) AS confidence FROM x""")
def evidence(spark: SparkSession, folder: str) -> DataFrame:
    m, held, _ = parts(spark, folder)
    people = m.select("chain", "contract", F.col("src").alias("address"))
    first = m.groupBy("chain", "contract", "token").agg(F.min_by("dst", F.struct("ts", "event_id")).alias("dst"))
    flows = m.where("is_sale").withColumn("kind", F.when(F.col("usd") >= 95, "withdrawal").when(F.col("usd") < 1, "cashout"))
    return behavior.evidence_rows(m, held, graphs.edges(behavior.transfers_of(m)), graphs.strong_components(graphs.edges(behavior.sales_of(m))), people.where("address < 3"), people.where("address = 7"), flows, first)


NOW = 1_800_000_000


@query("e6_lifecycle", W + f""", v AS (SELECT s.chain, s.contract, s.ts, s.token, s.dst, row_number() OVER (PARTITION BY s.chain, s.contract ORDER BY s.ts, s.event_id) AS rn FROM sales s JOIN holders h ON h.chain = s.chain AND h.contract = s.contract AND h.token = s.token AND h.owner = s.dst WHERE s.usd > 0),
  f AS (SELECT chain, contract, min(ts) AS first_activity, min(ts) FILTER (NOT is_sale) AS first_transfer, min(ts) FILTER (is_sale) AS first_sale FROM moves GROUP BY ALL),
  a AS (SELECT * FROM v WHERE rn = 1), d AS (SELECT a.chain, a.contract, min(m.ts) AS disposed FROM a JOIN moves m ON m.chain = a.chain AND m.contract = a.contract AND m.token = a.token AND m.src = a.dst AND m.ts > a.ts GROUP BY ALL)
  SELECT f.chain, f.contract, first_activity, first_transfer, first_sale, a.ts AS first_victim, a.ts - first_activity AS to_first_victim, coalesce(disposed, {NOW}) - a.ts AS holding_seconds
  FROM f LEFT JOIN a ON a.chain = f.chain AND a.contract = f.contract LEFT JOIN d ON d.chain = f.chain AND d.contract = f.contract""")
def lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    m, held, _ = parts(spark, folder)
    return economics.lifecycle(m, held, NOW)


@query("e7_value_flow", W + """, p AS (SELECT s.chain, s.contract, s.src, round(sum(coalesce(s.usd, 0)), 4) AS usd FROM sales s JOIN roles r ON r.chain = s.chain AND r.contract = s.contract AND r.address = s.src AND r.role = 'operator' GROUP BY ALL),
  t AS (SELECT chain, contract, arg_min(src, (-usd, src)) AS top_receiver, max(usd) AS top_usd, round(max(usd) / nullif(sum(usd), 0), 6) AS top_share FROM p GROUP BY ALL),
  z AS (SELECT chain, contract, count(DISTINCT token) AS nfts, count(*) FILTER (NOT is_sale) AS transfers, count(*) FILTER (is_sale) AS sales, round(sum(coalesce(usd, 0)), 4) AS gross_usd FROM moves GROUP BY ALL),
  q AS (SELECT chain, contract, count(*) FILTER (role = 'operator') AS operators, count(*) FILTER (role = 'victim') AS victims FROM roles GROUP BY ALL)
  SELECT chain, contract, nfts, transfers, sales, gross_usd, operators, victims, top_receiver, top_usd, top_share FROM z LEFT JOIN q USING (chain, contract) LEFT JOIN t USING (chain, contract)""")
def value_flow(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = parts(spark, folder)
    return economics.value_flow(m, role)


@query("e8_exposure", W + """, o AS (SELECT s.chain, s.contract, count(*) AS operator_sales, round(sum(coalesce(usd, 0)), 4) AS operator_output_usd FROM sales s JOIN roles r ON r.chain = s.chain AND r.contract = s.contract AND r.address = s.src AND r.role = 'operator' GROUP BY ALL),
  l AS (SELECT s.chain, s.contract, round(sum(usd), 4) AS honest_loss_usd, count(DISTINCT s.token) AS stuck_nfts FROM sales s JOIN holders h ON h.chain = s.chain AND h.contract = s.contract AND h.token = s.token AND h.owner = s.dst WHERE usd > 0 GROUP BY ALL)
  SELECT chain, contract, coalesce(operator_sales, 0) AS operator_sales, coalesce(operator_output_usd, 0) AS operator_output_usd, coalesce(honest_loss_usd, 0) AS honest_loss_usd, coalesce(stuck_nfts, 0) AS stuck_nfts FROM (SELECT DISTINCT chain, contract FROM moves) LEFT JOIN o USING (chain, contract) LEFT JOIN l USING (chain, contract)""")
def exposure(spark: SparkSession, folder: str) -> DataFrame:
    m, held, role = parts(spark, folder)
    return economics.exposure(m, role, held)


@query("e9_flow_kinds", W + ", op AS (SELECT DISTINCT address FROM roles WHERE role = 'operator' AND address % 3 = 0), ct AS (SELECT DISTINCT src AS address FROM sales WHERE src % 3 = 1) SELECT event_id, CASE WHEN src IN (FROM op) AND dst IN (FROM ct) THEN 'funding' WHEN src IN (FROM ct) AND dst IN (FROM op) THEN 'withdrawal' ELSE 'revenue_backflow' END AS kind FROM moves WHERE dst IN (FROM op) OR (src IN (FROM op) AND dst IN (FROM ct))")
def flow_kinds(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = parts(spark, folder)
    # operators and contracts of the flows: a third of the addresses each, as the two sides of native payments
    operators = role.where("role = 'operator' AND address % 3 = 0").select("address")
    contracts = behavior.sales_of(m).where("src % 3 = 1").select(F.col("src").alias("address"))
    return economics.classify_flow(m.select("event_id", "src", "dst"), operators, contracts).select("event_id", "kind")


@query("e10_activity_window", W + " SELECT chain, contract, greatest(min(ts // 12) - 50000, 0) AS lowest, max(ts // 12) + 50000 AS highest FROM moves GROUP BY ALL")
def activity_window(spark: SparkSession, folder: str) -> DataFrame:
    # blocks of twelve seconds
    return economics.activity_window(moves(spark, folder).withColumn("block", F.expr("ts div 12")), 50_000)


#: Six signals of a legitimate relation, any of which is enough.
LEGIT = {"official": "contract IN ('c1', 'c5')", "same_controller": "src % 9 = 4", "same_deployer": "src = dst - 1", "verified": "coalesce(usd >= 97, false)", "licensed": "token % 17 = 3", "migration": "event_id % 50 = 0"}


@query("e12_legitimacy", W + f", s AS (SELECT chain, contract, {' OR '.join(LEGIT.values())} AS legit FROM moves) SELECT chain, contract, count(*) FILTER (legit) AS legit_relations, count(*) FILTER (NOT legit) AS suspicious_relations, CASE WHEN bool_and(legit) THEN 'legitimate' ELSE 'suspected' END AS state FROM s GROUP BY ALL")
def legitimacy(spark: SparkSession, folder: str) -> DataFrame:
    return economics.legitimate(moves(spark, folder).selectExpr("chain", "contract", *(f"{v} AS {k}" for k, v in LEGIT.items())), list(LEGIT))


@query("e16_lifecycle_stages", W + ", a AS (SELECT chain, contract, min(ts) AS a, min(ts) FILTER (NOT is_sale) AS b, min(ts) FILTER (is_sale) AS c, max(ts) AS d FROM moves GROUP BY ALL), l AS (SELECT chain, contract, 0 AS i, 'activity' AS stage, a AS started FROM a UNION ALL SELECT chain, contract, 1, 'spread', b FROM a WHERE b IS NOT NULL UNION ALL SELECT chain, contract, 2, 'sale', c FROM a WHERE c IS NOT NULL UNION ALL SELECT chain, contract, 3, 'last', d FROM a) SELECT chain, contract, stage, started, lead(stage) OVER w AS next_stage, lead(started) OVER w - started AS seconds FROM l WINDOW w AS (PARTITION BY chain, contract ORDER BY started, i)")
def lifecycle_stages(spark: SparkSession, folder: str) -> DataFrame:
    return economics.lifecycle_stages(moves(spark, folder))


@query("j12_merged_moves", W + ", s AS (SELECT chain, contract, CAST(event_id // 2 AS VARCHAR) AS tx, token, src, dst, any_value(usd) AS usd FROM sales GROUP BY ALL), t AS (SELECT DISTINCT chain, contract, CAST(event_id // 2 AS VARCHAR) AS tx, token, src, dst FROM moves WHERE event_id % 3 <> 0) SELECT chain, contract, tx, token, src, dst, s.usd IS NOT NULL AS is_sale, t.tx IS NOT NULL AS is_transfer, usd FROM s FULL JOIN t USING (chain, contract, tx, token, src, dst)")
def merged_moves(spark: SparkSession, folder: str) -> DataFrame:
    m = moves(spark, folder).withColumn("tx", F.expr("cast(event_id div 2 as string)"))
    return economics.merged_moves(behavior.sales_of(m), m.where("event_id % 3 != 0"))


@query("j13_held_acquisitions", W + " SELECT s.event_id FROM sales s WHERE EXISTS (SELECT 1 FROM holders h WHERE h.chain = s.chain AND h.contract = s.contract AND h.token = s.token AND h.owner = s.dst)")
def held_acquisitions(spark: SparkSession, folder: str) -> DataFrame:
    m = moves(spark, folder)
    return behavior.sales_of(m).join(behavior.holders(m).withColumnRenamed("owner", "dst"), ["chain", "contract", "token", "dst"], "left_semi").select("event_id")


@query("j15_first_disposal", W + " SELECT a.event_id, min(b.ts) AS disposed FROM moves a JOIN moves b ON a.chain = b.chain AND a.contract = b.contract AND a.token = b.token AND a.dst = b.src AND b.ts > a.ts GROUP BY a.event_id")
def first_disposal(spark: SparkSession, folder: str) -> DataFrame:
    m = moves(spark, folder)
    later = m.select("chain", "contract", "token", F.col("src").alias("dst"), F.col("ts").alias("later"))
    return m.join(later, ["chain", "contract", "token", "dst"]).where("later > ts").groupBy("event_id").agg(F.min("later").alias("disposed"))


PRICES_SQL = ", prices AS (SELECT * FROM (VALUES ('ethereum', 'ETH', 2000.0), ('base', 'ETH', 2000.0), ('polygon', 'POL', 0.5), ('solana', 'SOL', 150.0)) t(chain, symbol, rate))"


@query("f12_currency", W + PRICES_SQL + " SELECT event_id, CASE event_id % 3 WHEN 0 THEN usd WHEN 1 THEN usd / rate END AS native, CASE event_id % 3 WHEN 0 THEN usd * rate WHEN 1 THEN usd END AS usd FROM sales JOIN prices USING (chain)")
def currency(spark: SparkSession, folder: str) -> DataFrame:
    prices = spark.createDataFrame([("ethereum", "ETH", 2000.0), ("base", "ETH", 2000.0), ("polygon", "POL", 0.5), ("solana", "SOL", 150.0)], "chain string, symbol string, rate double")
    # four rows of prices
    own = behavior.sales_of(moves(spark, folder)).join(F.broadcast(prices), "chain")
    symbol = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.lower("symbol"))).when(F.col("event_id") % 3 == 1, F.lit("usdc")).otherwise(F.lit("DOGE"))
    money = economics.to_native_and_usd(F.col("chain"), F.col("usd"), symbol, F.col("rate"))
    return own.select("event_id", money.alias("m")).select("event_id", "m.native", "m.usd")


@query("f13_day_bucket", W + " SELECT chain, ts // 86400 AS day, count(*) AS sales, round(sum(usd), 2) AS usd FROM sales GROUP BY ALL")
def day_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return behavior.sales_of(moves(spark, folder)).groupBy("chain", F.floor(F.col("ts") / 86400).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("sales"), F.round(F.sum("usd"), 2).alias("usd"))


@query("r1_relation_state", W + " SELECT chain, contract, CASE WHEN bool_or(role = 'operator') THEN 'suspected' ELSE 'legitimate' END AS state, count(*) AS relations FROM roles GROUP BY ALL")
def relation_state(spark: SparkSession, folder: str) -> DataFrame:
    return parts(spark, folder)[2].groupBy("chain", "contract").agg(F.when(F.bool_or(F.col("role") == "operator"), "suspected").otherwise("legitimate").alias("state"), F.count(F.lit(1)).alias("relations"))


@query("r6_address_classes", W + ", a AS (SELECT address, count(*) FILTER (role = 'operator') AS o, count(*) FILTER (role = 'victim') AS v FROM roles GROUP BY 1) SELECT count(*) FILTER (o > 0) AS malicious, count(*) FILTER (o > 1) AS repeated, count(*) FILTER (v > 0) AS honest, count(*) FILTER (o > 0 AND v > 0) AS overlapping, count(*) AS total FROM a")
def address_classes(spark: SparkSession, folder: str) -> DataFrame:
    a = parts(spark, folder)[2].groupBy("address").agg(F.count(F.when(F.col("role") == "operator", 1)).alias("o"), F.count(F.when(F.col("role") == "victim", 1)).alias("v"))
    n = {"malicious": F.col("o") > 0, "repeated": F.col("o") > 1, "honest": F.col("v") > 0, "overlapping": (F.col("o") > 0) & (F.col("v") > 0)}
    return a.agg(*(F.count(F.when(c, 1)).alias(k) for k, c in n.items()), F.count(F.lit(1)).alias("total"))
