"""Queries of the final report, the money trace, propagation, pair choice and compatible hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.operators import behavior, economics, extra, metadata, names, reports
from tessera.plans import behavior_queries as BQ
from tessera.plans import dedup_queries as DQ
from tessera.plans.registry import ORACLES, query
from tessera.runtime import materialise
from tessera.sources.fixtures import MOVES_SQL, NFT_SQL, moves, nft, table

N = "WITH " + NFT_SQL
M = "WITH RECURSIVE " + MOVES_SQL

#: Evidence states of each contract, derived from its counts; complete where both families are.
EVIDENCE_SQL = """, ev AS (SELECT *, transfers IN ('complete', 'empty') AND sales_state IN ('complete', 'empty') AS complete FROM (
  SELECT chain, contract, (['complete', 'empty', 'truncated', 'failed', 'unavailable'])[CAST(count(*) % 5 AS INT) + 1] AS transfers,
         (['complete', 'empty', 'complete', 'empty', 'truncated'])[CAST(count(*) FILTER (is_sale) % 5 AS INT) + 1] AS sales_state FROM moves GROUP BY ALL))"""


def evidence_states(m: DataFrame) -> DataFrame:
    """chain, contract, transfers, sales_state, complete."""
    own = m.groupBy("chain", "contract").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_sale"), 1)).alias("s"))
    own = own.selectExpr("chain", "contract", "element_at(array('complete', 'empty', 'truncated', 'failed', 'unavailable'), cast(n % 5 as int) + 1) AS transfers", "element_at(array('complete', 'empty', 'complete', 'empty', 'truncated'), cast(s % 5 as int) + 1) AS sales_state")
    return own.withColumn("complete", F.col("transfers").isin("complete", "empty") & F.col("sales_state").isin("complete", "empty"))


INSTANCES_SQL = (
    BQ.FACTS_SQL
    + """, px AS (SELECT f.chain, f.contract, f.component, count(*) AS exits, sum(s.usd) AS exit_usd, any_value(f.usd) AS usd, any_value(f.sales) AS sales
  FROM facts f JOIN wash w ON w.chain = f.chain AND w.contract = f.contract AND w.component = f.component JOIN sales s ON s.chain = f.chain AND s.contract = f.contract AND s.src = w.address AND s.ts > f.ended
  JOIN roles r ON r.chain = s.chain AND r.contract = s.contract AND r.address = s.dst AND r.role = 'victim'
  WHERE NOT EXISTS (SELECT 1 FROM wash o WHERE o.chain = s.chain AND o.contract = s.contract AND o.component = f.component AND o.address = s.dst) GROUP BY f.chain, f.contract, f.component),
  transfers AS (SELECT * FROM moves WHERE NOT is_sale)"""
    + BQ.SCC_SQL.format(p="t", t="transfers")
    + """, de AS (SELECT DISTINCT m.chain, m.contract, a.component, b.component AS target, bool_or(m.is_sale AND m.usd > 0) AS valued FROM moves m JOIN tscc a ON a.chain = m.chain AND a.contract = m.contract AND a.address = m.src JOIN tscc b ON b.chain = m.chain AND b.contract = m.contract AND b.address = m.dst WHERE a.component <> b.component GROUP BY ALL),
  sk AS (SELECT d.chain, d.contract, d.component, count(*) AS fan_out, bool_or(EXISTS (SELECT 1 FROM de o WHERE o.chain = d.chain AND o.contract = d.contract AND o.component = d.target)) AS onward, bool_or(valued) AS valued FROM de d GROUP BY ALL),
  star AS (SELECT sk.chain, sk.contract, sk.component, CASE WHEN onward THEN 'sybil_distribution' WHEN valued THEN 'fraud_revenue' ELSE 'poisoning' END AS kind FROM sk
    WHERE fan_out >= 3 AND EXISTS (SELECT 1 FROM tscc c JOIN roles r ON r.chain = c.chain AND r.contract = c.contract AND r.address = c.address AND r.role = 'operator' WHERE c.chain = sk.chain AND c.contract = sk.contract AND c.component = sk.component)),
  lp AS (SELECT a.chain, a.contract, a.token, a.src AS start, a.dst AS middle, b.dst AS last, row_number() OVER (PARTITION BY a.chain, a.contract, a.token, a.src ORDER BY a.ts, a.event_id, b.ts, b.event_id) AS rn
    FROM moves a JOIN moves b ON a.chain = b.chain AND a.contract = b.contract AND a.token = b.token AND a.dst = b.src AND b.ts > a.ts AND b.dst <> a.src
    JOIN roles r ON r.chain = a.chain AND r.contract = a.contract AND r.address = a.src AND r.role = 'operator'),
  iv AS (SELECT m.chain, m.contract, m.dst AS address FROM moves m JOIN (SELECT chain, contract, dst AS address FROM (SELECT DISTINCT chain, contract, src, dst FROM moves WHERE NOT is_sale) GROUP BY ALL HAVING count(*) >= 3) t ON t.chain = m.chain AND t.contract = m.contract AND t.address = m.dst
    JOIN roles r ON r.chain = m.chain AND r.contract = m.contract AND r.address = m.dst AND r.role = 'operator' GROUP BY ALL),
  inst AS (SELECT 'wash_trading' AS kind, chain, contract, CAST(component AS VARCHAR) AS instance, address FROM wash
    UNION SELECT 'pump_and_exit', w.chain, w.contract, CAST(w.component AS VARCHAR), w.address FROM wash w JOIN px ON px.chain = w.chain AND px.contract = w.contract AND px.component = w.component WHERE exit_usd / exits > usd / sales
    UNION SELECT s.kind, c.chain, c.contract, CAST(c.component AS VARCHAR), c.address FROM star s JOIN tscc c ON c.chain = s.chain AND c.contract = s.contract AND c.component = s.component
    UNION SELECT 'layered_transfer', chain, contract, token || ':' || start, unnest([start, middle, last]) FROM lp WHERE rn = 1
    UNION SELECT 'inventory_concentration', chain, contract, CAST(address AS VARCHAR), address FROM iv)"""
)


def instances(m: DataFrame, role: DataFrame) -> DataFrame:
    """kind, chain, contract, instance, address: the members of all instances of the five families of behaviour."""
    cycles = materialise(behavior.wash_cycles(m, role), "cycles")
    name = F.col("component").cast("string").alias("instance")
    columns = ["chain", "contract", "instance", "address"]
    pump = behavior.pump_and_exit(m, role, cycles, behavior.cycle_facts(m, cycles)).select("chain", "contract", "component")
    star = behavior.star_behaviors(m, role).select("chain", "contract", "component", "kind")
    linked = behavior.graphs_of_transfers(m)
    layers = behavior.layered(m, role).select("chain", "contract", F.concat_ws(":", F.col("token").cast("string"), F.col("start").cast("string")).alias("instance"), F.explode(F.array("start", "middle", "end")).alias("address"))
    held = behavior.inventory(m, role).select("chain", "contract", F.col("address").cast("string").alias("instance"), "address")
    own = cycles.select("chain", "contract", name, "address")
    out = own.withColumn("kind", F.lit("wash_trading"))
    out = out.unionByName(cycles.join(pump, ["chain", "contract", "component"], "left_semi").select("chain", "contract", name, "address").withColumn("kind", F.lit("pump_and_exit")))
    out = out.unionByName(linked.join(star, ["chain", "contract", "component"]).select("chain", "contract", name, "address", "kind"))
    out = out.unionByName(layers.withColumn("kind", F.lit("layered_transfer"))).unionByName(held.withColumn("kind", F.lit("inventory_concentration")))
    return out.select("kind", *columns).distinct()


@query("r5_behaviour_table", M + INSTANCES_SQL + EVIDENCE_SQL + """, fin AS (SELECT i.* FROM inst i JOIN ev ON ev.chain = i.chain AND ev.contract = i.contract WHERE complete),
  z AS (SELECT kind, count(DISTINCT (chain, contract)) AS contracts, count(DISTINCT (chain, contract, instance)) AS instances, count(DISTINCT (chain, address)) AS addresses FROM fin GROUP BY kind),
  nf AS (SELECT kind, count(DISTINCT (m.chain, m.contract, m.token)) AS nfts FROM fin JOIN moves m ON m.chain = fin.chain AND m.contract = fin.contract AND m.src = fin.address GROUP BY kind),
  bu AS (SELECT kind, count(DISTINCT (chain, dst)) AS buyers, round(sum(usd), 2) AS exposure_usd FROM (SELECT DISTINCT fin.kind, s.event_id, s.chain, s.dst, s.usd FROM fin JOIN sales s ON s.chain = fin.chain AND s.contract = fin.contract AND s.src = fin.address
    JOIN roles r ON r.chain = s.chain AND r.contract = s.contract AND r.address = s.dst AND r.role = 'victim') GROUP BY kind)
  SELECT kind, contracts, instances, addresses, coalesce(nfts, 0) AS nfts, coalesce(buyers, 0) AS buyers, coalesce(exposure_usd, 0.0) AS exposure_usd, (SELECT count(*) FROM ev WHERE complete) AS denominator, round(contracts / (SELECT count(*) FROM ev WHERE complete), 6) AS coverage FROM z LEFT JOIN nf USING (kind) LEFT JOIN bu USING (kind)""")
def behaviour_table(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = BQ.parts(spark, folder)
    role = materialise(role, "roles")
    complete = evidence_states(m).where("complete").select("chain", "contract")
    return reports.behaviour_table(materialise(instances(m, role), "instances"), m, role, complete)


GAS_STAGE_SQL = BQ.GAS_SQL + ", go AS (SELECT chain, contract, tx, max(gas) AS gas, max(CASE stage WHEN 'setup' THEN 0 WHEN 'lure' THEN 1 ELSE 2 END) AS o, bool_or(funding) AS f FROM gas GROUP BY ALL), gs AS (SELECT chain, contract, CASE WHEN f OR o = 0 THEN 'setup' WHEN o = 1 THEN 'lure' ELSE 'exit' END AS stage, gas FROM go)"


@query("r7_economics", M + GAS_STAGE_SQL + EVIDENCE_SQL + """, ou AS (SELECT s.chain, s.contract, sum(usd) AS v FROM sales s JOIN roles r ON r.chain = s.chain AND r.contract = s.contract AND r.address = s.src AND r.role = 'operator' GROUP BY ALL),
  lo AS (SELECT s.chain, s.contract, sum(usd) AS v, count(DISTINCT s.token) AS n FROM sales s JOIN holders h ON h.chain = s.chain AND h.contract = s.contract AND h.token = s.token AND h.owner = s.dst WHERE usd > 0 GROUP BY ALL),
  gr AS (SELECT chain, contract, sum(usd) AS v FROM sales GROUP BY ALL), rk AS (SELECT *, row_number() OVER (ORDER BY v DESC) AS rn FROM gr),
  gc AS (SELECT chain, contract, sum(gas) AS v FROM gs GROUP BY ALL), al AS (SELECT DISTINCT chain, contract FROM moves),
  oi AS (SELECT sum(coalesce(ou.v, 0)) / sum(gc.v) AS every, sum(coalesce(ou.v, 0)) FILTER (complete) / sum(gc.v) FILTER (complete) AS whole FROM gc JOIN ev USING (chain, contract) LEFT JOIN ou USING (chain, contract))
  SELECT 'gross_usd' AS metric, round(sum(v), 2) AS value FROM gr UNION ALL SELECT 'operator_output_usd', round(sum(v), 2) FROM ou UNION ALL SELECT 'honest_loss_usd', round(sum(v), 2) FROM lo
  UNION ALL SELECT 'stuck_nfts', sum(n) FROM lo UNION ALL SELECT 'stuck_ratio', round((SELECT sum(n) FROM lo) / (SELECT count(*) FROM holders), 6)
  UNION ALL SELECT 'gas_' || stage, round(sum(gas), 2) FROM gs GROUP BY stage UNION ALL SELECT 'funding_txs', count(*) FROM go WHERE f
  UNION ALL SELECT 'output_input', round(every, 6) FROM oi UNION ALL SELECT 'output_input_complete', round(whole, 6) FROM oi
  UNION ALL SELECT 'top_tenth_share', round(sum(v) FILTER (rn <= ceil(0.1 * (SELECT count(*) FROM al))) / sum(v), 6) FROM rk""")
def economics_report(spark: SparkSession, folder: str) -> DataFrame:
    """metric, value: sums, gas by stage, stuck share, output to input (all, and of complete evidence), concentration."""
    key = ["chain", "contract"]
    m, held, role = BQ.parts(spark, folder)
    gas = m.selectExpr(*key, "cast(event_id div 3 as string) AS tx", "element_at(array('setup', 'lure', 'exit'), cast(event_id % 3 as int) + 1) AS stage", "coalesce(usd, 1.0D) AS gas", "event_id % 7 = 0 AS funding")
    per = m.groupBy(*key).agg(F.sum("usd").alias("gross")).join(economics.gas_sums(gas), key).join(economics.exposure_exact(m, role, held), key, "left").join(evidence_states(m).select(*key, "complete"), key)
    per = materialise(per, "contract-economics")
    # one row of totals, over contracts
    w = "row_number() over (order by gross desc nulls last)"
    ranked = per.where("gross is not null").selectExpr("gross", f"{w} AS rn")
    most = F.ceil(F.lit(0.1) * per.count())
    top = ranked.agg((F.sum(F.when(F.col("rn") <= most, F.col("gross"))) / F.sum("gross")).alias("top"))
    tokens = held.agg(F.count(F.lit(1)).alias("tokens"))
    out, whole = F.coalesce("output", F.lit(0.0)), F.col("complete")
    sums = per.agg(F.sum("gross").alias("gross"), F.sum("output").alias("output"), F.sum("loss").alias("loss"), F.sum("stuck").alias("stuck"), *(F.sum(f"gas_{s}").alias(f"gas_{s}") for s in ("setup", "lure", "exit")), F.sum("funding_txs").alias("funding_txs"), (F.sum(out) / F.sum("gas")).alias("oi"), (F.sum(F.when(whole, out)) / F.sum(F.when(whole, F.col("gas")))).alias("oiw"))
    one = sums.crossJoin(top).crossJoin(tokens)  # single rows
    values = {"gross_usd": F.round("gross", 2), "operator_output_usd": F.round("output", 2), "honest_loss_usd": F.round("loss", 2), "stuck_nfts": F.col("stuck"), "stuck_ratio": F.round(F.col("stuck") / F.col("tokens"), 6), **{f"gas_{s}": F.round(f"gas_{s}", 2) for s in ("setup", "lure", "exit")}, "funding_txs": F.col("funding_txs"), "output_input": F.round("oi", 6), "output_input_complete": F.round("oiw", 6), "top_tenth_share": F.round("top", 6)}
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()))).alias("x")).select("x.*")


@query("r8_data_quality", M + EVIDENCE_SQL + """, pc AS (SELECT chain, contract, count(*) FILTER (is_sale AND usd IS NOT NULL) AS p, count(*) FILTER (NOT is_sale) AS u FROM moves GROUP BY ALL),
  st AS (SELECT unnest(['complete', 'empty', 'truncated', 'failed', 'unavailable']) AS state)
  SELECT 'events' AS family, 'priced' AS state, CAST(sum(p) AS BIGINT) AS n FROM pc UNION ALL SELECT 'events', 'unpriced', CAST(sum(u) AS BIGINT) FROM pc
  UNION ALL SELECT 'pricing', CASE WHEN p + u = 0 THEN 'empty' WHEN u = 0 THEN 'complete' WHEN p = 0 THEN 'unpriced' ELSE 'partial' END, count(*) FROM pc GROUP BY 2
  UNION ALL SELECT 'transfers', state, count(ev.chain) FROM st LEFT JOIN ev ON ev.transfers = state GROUP BY state UNION ALL SELECT 'sales', state, count(ev.chain) FROM st LEFT JOIN ev ON ev.sales_state = state GROUP BY state
  UNION ALL SELECT 'truncation', CASE WHEN transfers = 'truncated' OR sales_state = 'truncated' THEN 'truncated' ELSE 'whole' END, count(*) FROM ev GROUP BY 2""")
def data_quality(spark: SparkSession, folder: str) -> DataFrame:
    """family, state, n: priced and unpriced events, contracts by state of pricing, of evidence families, and of truncation."""
    m = materialise(moves(spark, folder), "moves")
    counts = m.groupBy("chain", "contract").agg(F.count(F.when(F.col("is_sale") & F.col("usd").isNotNull(), 1)).alias("p"), F.count(F.when(~F.col("is_sale"), 1)).alias("u"))
    events = counts.select(F.explode(F.array(F.struct(F.lit("priced").alias("state"), F.col("p").alias("k")), F.struct(F.lit("unpriced").alias("state"), F.col("u").alias("k")))).alias("x")).groupBy(F.lit("events").alias("family"), "x.state").agg(F.sum("x.k").alias("n"))
    pricing = counts.groupBy(F.lit("pricing").alias("family"), reports.pricing_state(F.col("p"), F.col("u")).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    states = evidence_states(m).withColumnRenamed("sales_state", "sales")
    cut = F.when((F.col("transfers") == "truncated") | (F.col("sales") == "truncated"), "truncated").otherwise("whole")
    truncation = states.groupBy(F.lit("truncation").alias("family"), cut.alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return events.unionByName(pricing).unionByName(reports.state_histogram(states, ["transfers", "sales"]).withColumnRenamed("contracts", "n")).unionByName(truncation)


@query("r3_population", M + EVIDENCE_SQL + """, c AS (SELECT m.chain, m.contract, CASE WHEN any_value(complete) THEN count(DISTINCT m.token) END AS provider, count(DISTINCT m.token) FILTER (is_sale) AS fallback FROM moves m JOIN ev ON ev.chain = m.chain AND ev.contract = m.contract GROUP BY ALL),
  h AS (SELECT chain, contract, count(*) AS snapshot FROM holders WHERE token % 3 <> 0 GROUP BY ALL)
  SELECT chain, contract, greatest(coalesce(provider, snapshot, fallback), fallback) AS population, provider IS NOT NULL AS complete FROM c LEFT JOIN h USING (chain, contract)""")
def population(spark: SparkSession, folder: str) -> DataFrame:
    m = materialise(moves(spark, folder), "moves")
    key = ["chain", "contract"]
    counts = m.groupBy(*key).agg(F.countDistinct("token").alias("all"), F.countDistinct(F.when(F.col("is_sale"), F.col("token"))).alias("fallback"))
    snapshot = behavior.holders(m).where("token % 3 != 0").groupBy(*key).agg(F.count(F.lit(1)).alias("snapshot"))
    own = counts.join(evidence_states(m), key).join(snapshot, key, "left")
    return reports.population(own.select(*key, F.when(F.col("complete"), F.col("all")).alias("provider"), "snapshot", "fallback"))


@query("r2_infringing_nfts", N + DQ.MEMBERS_SQL + DQ.SEED_URI_SQL + """, li AS (SELECT chain, contract, row_order FROM te UNION SELECT chain, contract, row_order FROM ie), rl AS (SELECT chain, contract FROM li UNION SELECT b.chain, b.contract FROM seeds JOIN members a ON a.chain = seed_chain AND a.contract = seed_contract JOIN members b ON a.name = b.name WHERE b.chain <> seed_chain OR b.contract <> seed_contract),
  lc AS (SELECT chain, contract, count(*) AS listed FROM li GROUP BY ALL) SELECT chain, contract, coalesce(listed, 0) AS listed, CASE WHEN listed IS NULL THEN size.nfts ELSE 0 END AS fallback, coalesce(listed, size.nfts) AS nfts FROM rl LEFT JOIN lc USING (chain, contract) LEFT JOIN size USING (chain, contract)""")
def infringing_nfts(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder)
    listed = DQ.uri.seed_uri_rows(own, DQ.seeds(spark, folder))
    relations = listed.select("chain", "contract").union(DQ.seed_names(spark, folder).select("chain", "contract"))
    return reports.infringing(listed.select("chain", "contract", "row_order").distinct(), relations, own.groupBy("chain", "contract").agg(F.count(F.lit(1)).alias("nfts")))


ENTITY_SQL = "(VALUES " + ", ".join(f"({i}, '{a}', '{r}')" for i, (_, a, r, _) in enumerate(reports.KNOWN_ENTITIES)) + ") k(i, address, role)"


@query("e20_flow_classes", M + f", f AS (SELECT chain, coalesce(k.address, '0x' || dst) AS address, usd, CASE WHEN chain = 'ethereum' THEN k.role END AS role FROM moves LEFT JOIN {ENTITY_SQL} ON dst = i) SELECT chain, coalesce(role, 'external_wallet') AS to_role, count(*) AS edges, count(DISTINCT address) AS receivers, round(sum(usd), 2) AS usd, count(*) FILTER (usd IS NULL) AS unpriced, round(count(*) FILTER (usd IS NULL) / count(*), 6) AS gap FROM f GROUP BY 1, 2")
def flow_classes(spark: SparkSession, folder: str) -> DataFrame:
    known = spark.createDataFrame(list(reports.KNOWN_ENTITIES), "chain string, address string, role string, label string")
    address = F.concat(F.lit("0x"), F.col("dst").cast("string"))
    for i, (_, a, _, _) in enumerate(reports.KNOWN_ENTITIES):
        address = F.when(F.col("dst") == i, F.lit(a.upper().replace("0X", "0x"))).otherwise(address)
    return reports.flow_classes(moves(spark, folder).select("chain", address.alias("address"), "usd"), known)


PAID_SQL = ", ps AS (SELECT event_id, src, dst, usd, (['ETH', 'USDC'])[CAST(event_id % 2 AS INT) + 1] AS currency, ts // 3600 AS block, event_id AS place FROM sales WHERE usd > 0 AND src <> 0 AND dst <> 0 AND src <> dst), n0 AS (SELECT event_id AS start_event, * FROM ps WHERE usd >= 90)"
TRACE_SQL = "".join(
    f""", n{h} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY start_event ORDER BY block, place, event_id) AS rn FROM (
  SELECT DISTINCT p.start_event, s.* FROM n{h - 1} p JOIN ps s ON s.src = p.dst AND s.currency = p.currency AND (s.block > p.block OR (s.block = p.block AND s.place > p.place)) AND s.usd >= 0.05 * p.usd AND s.usd <= 1.02 * p.usd)) WHERE rn <= 32)"""
    for h in (1, 2, 3)
)


@query("g7_money_trace", M + PAID_SQL + TRACE_SQL + " SELECT start_event, hop, event_id, src, dst, usd FROM (" + " UNION ALL ".join(f"SELECT start_event, {h} AS hop, event_id, src, dst, usd FROM n{h}" for h in range(4)) + ")")
def money_trace(spark: SparkSession, folder: str) -> DataFrame:
    sold = behavior.sales_of(moves(spark, folder)).where("usd > 0 AND src != 0 AND dst != 0")
    paid = sold.selectExpr("event_id", "src", "dst", "usd", "element_at(array('ETH', 'USDC'), cast(event_id % 2 as int) + 1) AS currency", "ts div 3600 AS block", "event_id AS place")
    return extra.trace(paid, paid.where("usd >= 90").select("event_id"))


@query("g9_nodes", M + ", e AS (SELECT chain, contract, src AS address, 1 AS s, ts FROM moves UNION ALL SELECT chain, contract, dst, 0, ts FROM moves) SELECT e.chain, e.contract, e.address, any_value(role) AS role, CAST(sum(s) AS BIGINT) AS sent, CAST(sum(1 - s) AS BIGINT) AS received, min(ts) AS first_ts FROM e JOIN roles r ON r.chain = e.chain AND r.contract = e.contract AND r.address = e.address GROUP BY ALL")
def propagation_nodes(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = BQ.parts(spark, folder)
    return reports.propagation_nodes(m, role)


@query("g9_token_paths", M + " SELECT chain, contract, token, row_number() OVER (PARTITION BY chain, contract, token ORDER BY ts, event_id) AS step, src, dst, ts FROM moves")
def token_paths(spark: SparkSession, folder: str) -> DataFrame:
    return reports.token_paths(moves(spark, folder))


@query("g9_summary", M + ", n AS (SELECT chain, contract, count(*) AS addresses FROM (SELECT chain, contract, src AS a FROM moves UNION SELECT chain, contract, dst FROM moves) GROUP BY ALL), f AS (SELECT chain, contract, CAST(sum(k) AS BIGINT) AS edges, max(k) AS largest_fan_out FROM (SELECT chain, contract, src, count(DISTINCT dst) AS k FROM moves GROUP BY ALL) GROUP BY ALL), p AS (SELECT chain, contract, count(*) AS tokens, max(k) AS longest_path FROM (SELECT chain, contract, token, count(*) AS k FROM moves GROUP BY ALL) GROUP BY ALL) SELECT * FROM n JOIN f USING (chain, contract) JOIN p USING (chain, contract)")
def propagation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.propagation_summary(materialise(moves(spark, folder), "moves"))


@query("e4_operator_levels", "WITH e AS (" + ORACLES["e3_evidence"] + "), s AS (SELECT chain, contract, address, round(sum(weight * confidence), 4) AS score FROM e GROUP BY ALL) SELECT *, CASE WHEN score >= 1.5 THEN 'L1' WHEN score >= 0.75 THEN 'L2' ELSE 'L3' END AS level FROM s")
def operator_levels(spark: SparkSession, folder: str) -> DataFrame:
    return extra.operator_levels(BQ.evidence(spark, folder))


@query("d8_pair_choice", N + DQ.PAIRED_SQL.replace("{threshold}", "0.6") + ' SELECT mt.l AS "left", mt.r AS "right", md5(x.body) AS left_doc, md5(y.body) AS right_doc FROM mt JOIN ch ON ch.l = mt.l AND ch.r = mt.r JOIN txt x ON x.doc = ld JOIN txt y ON y.doc = rd')
def pair_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The documents on which matching members (EVM contracts and Solana NFTs) are compared."""
    own = nft(spark, folder)
    both = F.struct("doc", F.md5(F.col("body").cast("binary")).alias("md5"))
    held = metadata.anchors(metadata.numbered(own).withColumn("both", both), "both", "both").select("member", "contract", "chain", "token_key", "both.doc", "both.md5", "nfts")
    held = materialise(held, "metadata-anchors")
    links = materialise(metadata.numbered_links(own, held, 0.6), "metadata-links")
    pairs = materialise(metadata.member_pairs(held, links), "member-pairs")
    rows = held.select(F.col("member").alias("contract"), "chain", "token_key", F.col("md5").alias("doc"))
    return metadata.aligned_documents(rows, pairs)


FNV_SQL = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


def _mix_sql(h: str) -> str:
    one = f"((xor({h}, {h} >> 30) * 13787848793156543929) % 18446744073709551616)"
    return f"SELECT key, xor(b, b >> 31) AS h FROM (SELECT key, (xor(a, a >> 27) * 10723151780598845931) % 18446744073709551616 AS b FROM (SELECT key, {one} AS a FROM x))"


@query("f9_token_hash", f"WITH x AS (SELECT p_partkey AS key, {FNV_SQL} AS h0 FROM part), y AS (SELECT p_partkey AS key, (p_partkey::UHUGEINT + 11400714819323198485) % 18446744073709551616 AS h0 FROM part), t AS ({_mix_sql('h0')}), s AS ({_mix_sql('h0').replace('FROM x', 'FROM y')}) SELECT t.key AS p_partkey, lower(lpad(printf('%x', CAST(t.h AS UBIGINT)), 16, '0')) AS token_hash, lower(lpad(printf('%x', CAST(s.h AS UBIGINT)), 16, '0')) AS split_mix FROM t JOIN s USING (key)")
def token_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", hashing.token_hash_udf("p_name").alias("token_hash"), hashing.splitmix64_udf("p_partkey").alias("split_mix"))


@query("f10_md5_lower", "SELECT page_id, CAST(md5_number_lower(url) AS VARCHAR) AS h FROM pages")
def md5_lower(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", hashing.md5_lower(F.col("url")).alias("h"))


@query("e4_five_roles", M + BQ.SALE_SCC + """, op AS (SELECT DISTINCT chain, contract, src AS address FROM moves WHERE src < 3 UNION SELECT chain, contract, unnest([src, dst]) FROM sales WHERE usd >= 95 OR usd < 1),
  al AS (SELECT chain, contract, src AS address FROM moves UNION SELECT chain, contract, dst FROM moves), pa AS (SELECT DISTINCT chain, contract, dst AS address FROM sales WHERE usd > 0),
  ring AS (SELECT c.chain, c.contract, c.address FROM sscc c WHERE (c.chain, c.contract, c.component) IN (SELECT (chain, contract, component) FROM sscc GROUP BY chain, contract, component HAVING count(*) >= 2) AND (c.chain, c.contract, c.component) IN (SELECT (s.chain, s.contract, s.component) FROM sscc s JOIN op USING (chain, contract, address)))
  SELECT chain, contract, address, CASE WHEN (chain, contract, address) IN (SELECT (chain, contract, address) FROM op) THEN 'suspected_operator'
    WHEN (chain, contract, address) IN (SELECT (chain, contract, address) FROM pa) AND (chain, contract, address) IN (SELECT (chain, contract, src) FROM moves) THEN 'corrupted_victim'
    WHEN (chain, contract, address) IN (SELECT (chain, contract, address) FROM pa) AND (chain, contract, address) IN (SELECT (chain, contract, owner) FROM holders) THEN 'likely_victim'
    WHEN (chain, contract, address) IN (SELECT (chain, contract, address) FROM ring) THEN 'suspected_colluder' ELSE 'neutral' END AS role FROM al""")
def five_roles(spark: SparkSession, folder: str) -> DataFrame:
    m, held, _ = BQ.parts(spark, folder)
    graph = behavior.graphs_of_sales(m)
    return behavior.five_roles(m, held, m.where("src < 3").select("chain", "contract", F.col("src").alias("address")), m.where("is_sale and (usd >= 95 or usd < 1)"), graph)


@query("e18_early_features", M + """, st AS (SELECT chain, contract, min(ts) AS start, min(ts) FILTER (is_sale) AS sale FROM moves GROUP BY ALL),
  vi AS (SELECT s.chain, s.contract, min(s.ts) AS victim FROM sales s JOIN holders h ON h.chain = s.chain AND h.contract = s.contract AND h.token = s.token AND h.owner = s.dst WHERE s.usd > 0 GROUP BY ALL),
  mi AS (SELECT *, row_number() OVER (PARTITION BY chain, contract, token ORDER BY ts, event_id) = 1 AS mint FROM moves), ba AS (SELECT *, unnest([60, 3600, 86400]) AS secs FROM st LEFT JOIN vi USING (chain, contract))
  SELECT b.chain, b.contract, CAST(secs AS INT) AS "window", count(*) AS moves, count(*) FILTER (mint) AS mints, count(*) FILTER (is_sale) AS sales, count(DISTINCT src) AS senders, round(sum(coalesce(usd, 0)), 4) AS usd,
    coalesce(any_value(sale) <= any_value(start) + secs, false) AS sale_observed, coalesce(any_value(victim) <= any_value(start) + secs, false) AS victim_observed, coalesce(any_value(sale) > any_value(start) + secs, false) OR coalesce(any_value(victim) > any_value(start) + secs, false) AS future_positive
  FROM ba b JOIN mi ON mi.chain = b.chain AND mi.contract = b.contract AND mi.ts <= b.start + secs GROUP BY b.chain, b.contract, secs""")
def early_features(spark: SparkSession, folder: str) -> DataFrame:
    m, held, _ = BQ.parts(spark, folder)
    bought = behavior.sales_of(m).where("usd > 0").join(held.withColumnRenamed("owner", "dst"), ["chain", "contract", "token", "dst"], "left_semi")
    return behavior.early_features(m, bought.select("chain", "contract", "ts"))


CLASSES_SQL = ", ee AS (SELECT DISTINCT chain || '/' || contract AS contract, 'shared_deployer:' || arg_min(src, (ts, event_id)) OVER (PARTITION BY chain, contract) % 40 AS ev FROM moves UNION SELECT chain || '/' || contract, 'shared_value_recipient:' || src FROM sales WHERE usd >= 99 UNION SELECT chain || '/' || contract, 'shared_address:' || owner FROM holders WHERE token % 5 = 0)"


@query("e17_campaign_confidence", M + CLASSES_SQL + """, ed AS (SELECT DISTINCT a.contract AS a, b.contract AS b FROM ee a JOIN ee b USING (ev) WHERE a.contract <> b.contract), rr AS (SELECT a, b FROM ed UNION SELECT rr.a, ed.b FROM rr JOIN ed ON ed.a = rr.b),
  mb AS (SELECT a AS contract, least(a, min(b)) AS campaign FROM rr GROUP BY a), sh AS (SELECT campaign, ev, count(*) AS n FROM ee JOIN mb USING (contract) GROUP BY ALL HAVING count(*) > 1),
  lv AS (SELECT campaign, count(*) AS shared, max(CASE WHEN ev LIKE 'shared_deployer:%' OR ev LIKE 'shared_value_recipient:%' THEN 2 ELSE 1 END) AS l FROM sh GROUP BY 1)
  SELECT campaign, count(*) AS contracts, any_value(shared) AS shared, CASE any_value(l) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM mb JOIN lv USING (campaign) GROUP BY campaign""")
def campaign_confidence(spark: SparkSession, folder: str) -> DataFrame:
    m, held, _ = BQ.parts(spark, folder)
    contract = F.concat("chain", F.lit("/"), "contract").alias("contract")
    first = m.groupBy("chain", "contract").agg((F.min_by("src", F.struct("ts", "event_id")) % 40).alias("d")).select(contract, F.concat(F.lit("shared_deployer:"), F.col("d").cast("string")).alias("evidence"))
    paid = m.where("is_sale and usd >= 99").select(contract, F.concat(F.lit("shared_value_recipient:"), F.col("src").cast("string")).alias("evidence"))
    own = held.where("token % 5 = 0").select(contract, F.concat(F.lit("shared_address:"), F.col("owner").cast("string")).alias("evidence"))
    every = materialise(first.unionByName(paid).unionByName(own).distinct(), "campaign-evidence")
    return extra.campaign_confidence(every, extra.campaigns(every))
