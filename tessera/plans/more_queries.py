"""Queries of further operators: decoding, predicates, joins, windows, seeds, campaigns, traces and report figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.similarity import K1, B, best_from_overlap, jaro_winkler_udf, least_overlap, letter_tokens
from tessera.operators import behavior, economics, extra, metadata, names, uri
from tessera.plans import behavior_queries as BQ
from tessera.plans import dedup_queries as DQ
from tessera.plans.registry import ORACLES, query
from tessera.runtime import materialise
from tessera.sources import chain_logs
from tessera.sources.fixtures import MOVES_SQL, NFT_SQL, moves, nft, table

N = "WITH " + NFT_SQL
M = "WITH RECURSIVE " + MOVES_SQL


@query("s15_log_decode", "SELECT '0xabc' AS contract, lower(printf('%x', user_id + event_id)) AS token, 'ERC-721' AS standard FROM events WHERE event_id % 3 = 0 UNION ALL SELECT '0xabc', lower(printf('%x', user_id + event_id)), 'ERC-1155' FROM events WHERE event_id % 3 = 1 UNION ALL SELECT '0xabc', lower(printf('%x', user_id + event_id + i)), 'ERC-1155' FROM events, (VALUES (0), (1)) t(i) WHERE event_id % 3 = 2")
def log_decode(spark: SparkSession, folder: str) -> DataFrame:
    def pad(c):
        return F.lpad(F.lower(F.hex(c)), 64, "0")

    one, two = pad(F.col("user_id") + F.col("event_id")), pad(F.col("user_id") + F.col("event_id") + 1)
    kind = F.col("event_id") % 3
    topic0 = F.when(kind == 0, chain_logs.ERC721_TRANSFER).when(kind == 1, chain_logs.ERC1155_SINGLE).otherwise(chain_logs.ERC1155_BATCH)
    zero = F.lit("0x" + "0" * 64)
    data = F.when(kind == 0, F.lit("0x")).when(kind == 1, F.concat(F.lit("0x"), one, pad(F.lit(1)))).otherwise(F.concat(F.lit("0x"), pad(F.lit(64)), pad(F.lit(160)), pad(F.lit(2)), one, two, pad(F.lit(0))))
    logs = table(spark, folder, "events").select(F.lit("0xABC").alias("address"), F.array(topic0, zero, zero, F.concat(F.lit("0x"), one)).alias("topics"), data.alias("data"))
    return chain_logs.decode_transfers(logs)


@query("s18_metadata_accounts", "SELECT c_custkey AS account, c_name AS name, upper(substr(c_mktsegment, 1, 4)) AS symbol, 'ipfs://Qm' || md5(c_name) AS uri FROM customer")
def metadata_accounts(spark: SparkSession, folder: str) -> DataFrame:
    def text(c):
        n = F.octet_length(c)
        return F.concat(F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0")), F.unhex(F.lit("000000")), F.encode(c, "UTF-8"))

    own = table(spark, folder, "customer")
    data = F.concat(F.unhex(F.lit("04" + "11" * 32 + "22" * 32)), text(F.col("c_name")), text(F.upper(F.substring("c_mktsegment", 1, 4))), text(F.concat(F.lit("ipfs://Qm"), F.md5(F.col("c_name").cast("binary")))), F.unhex(F.lit("0000")))
    return chain_logs.decode_accounts(own.select(F.col("c_custkey").cast("string").alias("account"), data.alias("data"))).select(F.col("account").cast("long").alias("account"), "name", "symbol", "uri")


@query("s19_image_uri", "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE 'http://x/' || p_partkey END AS image FROM part")
def image_uri(spark: SparkSession, folder: str) -> DataFrame:
    u = F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"name": "n", "image": {"url": " '), u, F.lit(' "}}'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('{"a": [1, {"files": [{"uri": "v.mp4", "type": "video"}, {"uri": "'), u, F.lit('", "type": "image/png"}]}]}'))).otherwise(F.lit('{"a": 1'))
    return table(spark, folder, "part").select("p_partkey", chain_logs.image_uri_udf(raw).alias("image"))


@query("s20_expand_id", "SELECT p_partkey, 'ipfs://x/' || lpad(lower(printf('%x', p_partkey)), 64, '0') || '.json' AS uri FROM part")
def expand_id(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", chain_logs.expand_id(F.lit("ipfs://x/{id}.json"), F.col("p_partkey")).alias("uri"))


@query("f19_abi_string", "SELECT c_custkey, c_name AS text FROM customer")
def abi_string(spark: SparkSession, folder: str) -> DataFrame:
    pad = F.lpad(F.lower(F.hex(F.octet_length("c_name").cast("long"))), 64, "0")
    raw = F.concat(F.lit("0x"), F.lit("20".rjust(64, "0")), pad, F.lower(F.hex(F.encode("c_name", "UTF-8"))), F.lit("0" * 20))
    return table(spark, folder, "customer").select("c_custkey", chain_logs.abi_string(raw).alias("text"))


@query("p6_held", M + " SELECT owner, count(*) AS tokens FROM holders GROUP BY 1")
def held(spark: SparkSession, folder: str) -> DataFrame:
    own = behavior.holders(moves(spark, folder)).withColumn("balance", F.when(F.col("token") % 2 == 0, F.lit(1)))
    return own.where(F.col("balance").isNull() | (F.col("balance") > 0)).groupBy("owner").agg(F.count(F.lit(1)).alias("tokens"))


@query("p8_self_exclusion", N + " SELECT a.chain, a.contract, count(*) AS others FROM (SELECT DISTINCT chain, contract, name_norm FROM nft) a JOIN (SELECT DISTINCT chain, contract, name_norm FROM nft) b ON a.name_norm = b.name_norm AND (a.chain <> b.chain OR a.contract <> b.contract) GROUP BY ALL")
def self_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder).select("chain", "contract", "name_norm").distinct()
    size = own.groupBy("name_norm").agg(F.count(F.lit(1)).alias("n"))
    return own.join(size, "name_norm").groupBy("chain", "contract").agg(F.sum(F.col("n") - 1).alias("others")).where("others > 0")


@query("j4_overlapping_tokens", N + DQ.SEEDS_SQL + ", s AS (SELECT DISTINCT token_id FROM nft JOIN seeds ON chain = seed_chain AND contract = seed_contract) SELECT chain, contract, count(*) AS shared FROM nft WHERE token_id IN (SELECT token_id FROM s) GROUP BY ALL")
def overlapping_tokens(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder)
    ids = own.join(DQ.seeds(spark, folder), ["chain", "contract"], "left_semi").select("token_id").distinct()
    return own.join(ids, "token_id", "left_semi").groupBy("chain", "contract").agg(F.count(F.lit(1)).alias("shared"))


@query("j7_seed_fuzzy_names", N + DQ.SEEDS_SQL + ", s AS (SELECT DISTINCT name_norm AS seed FROM nft JOIN seeds ON chain = seed_chain AND contract = seed_contract WHERE trim(name_norm) <> ''), n AS (SELECT DISTINCT name_norm AS name FROM nft WHERE trim(name_norm) <> '') SELECT seed, name FROM s JOIN n ON seed <> name AND jaro_winkler_similarity(seed, name) >= 0.93")
def seed_fuzzy_names(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder).where(T.usable_name(F.col("name_norm")))
    seed = own.join(DQ.seeds(spark, folder), ["chain", "contract"], "left_semi").select(F.col("name_norm").alias("seed")).distinct()
    pairs = names.similar_names(own.select(F.col("name_norm").alias("name")), 0.93, seed.withColumnRenamed("seed", "name"))
    return pairs.select(F.col("left").alias("seed"), F.col("right").alias("name"))


@query("j10_aligned_documents", N + """, a AS (SELECT chain, chain || '/' || contract AS c, token_id, arg_max(md5(body), row_order) AS doc FROM nft GROUP BY ALL),
  t AS (SELECT chain, c, arg_max(doc, (length(token_id), token_id)) AS top FROM a GROUP BY ALL),
  k AS (SELECT DISTINCT seed_chain || '/' || seed_contract AS l, chain || '/' || contract AS r FROM (""" + ORACLES["d17_candidate_registry"] + """)),
  p AS (SELECT x.c AS "left", y.c AS "right", x.chain AS lc, y.chain AS rc, x.top AS lt, y.top AS rt FROM k JOIN t x ON x.c = l JOIN t y ON y.c = r),
  s AS (SELECT p."left", p."right", arg_max(x.doc, (length(x.token_id), x.token_id)) AS ld, arg_max(y.doc, (length(x.token_id), x.token_id)) AS rd FROM p JOIN a x ON x.c = p."left" JOIN a y ON y.c = p."right" AND y.token_id = x.token_id GROUP BY ALL)
  SELECT p."left", p."right", CASE WHEN lc <> 'solana' AND rc <> 'solana' AND ld IS NOT NULL THEN ld ELSE lt END AS left_doc, CASE WHEN lc <> 'solana' AND rc <> 'solana' AND ld IS NOT NULL THEN rd ELSE rt END AS right_doc FROM p LEFT JOIN s USING ("left", "right")""")
def aligned_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents on which each seed and each of its candidates, by any dimension, are compared."""
    own = nft(spark, folder).withColumn("contract", F.concat("chain", F.lit("/"), "contract")).groupBy("chain", "contract", "token_id").agg(F.max_by(F.md5(F.col("body").cast("binary")), "row_order").alias("doc"))
    anchors = own.select("contract", "chain", T.token_key(F.col("token_id")).alias("token_key"), "doc")
    pairs = DQ.candidate_registry(spark, folder).select(F.concat("seed_chain", F.lit("/"), "seed_contract").alias("left"), F.concat("chain", F.lit("/"), "contract").alias("right"))
    return metadata.aligned_documents(anchors, materialise(pairs, "candidates"))


@query("j14_exits_after_cycles", M + BQ.FACTS_SQL + " SELECT f.chain, f.contract, f.component, count(*) AS exits FROM facts f JOIN wash w ON w.chain = f.chain AND w.contract = f.contract AND w.component = f.component JOIN sales s ON s.chain = f.chain AND s.contract = f.contract AND s.src = w.address AND s.ts > f.ended GROUP BY ALL")
def exits_after_cycles(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = BQ.parts(spark, folder)
    cycles = behavior.wash_cycles(m, role)
    facts = behavior.cycle_facts(m, cycles).select("chain", "contract", "component", "ended")
    member = cycles.select("chain", "contract", F.col("address").alias("src"), "component")
    return behavior.sales_of(m).join(member, ["chain", "contract", "src"]).join(facts, ["chain", "contract", "component"]).where("ts > ended").groupBy("chain", "contract", "component").agg(F.count(F.lit(1)).alias("exits"))


@query("a3_distinct_and_rows", N + " SELECT chain, count(DISTINCT contract) AS contracts, count(*) AS nfts, count(DISTINCT token_uri) AS uris FROM nft GROUP BY chain")
def distinct_and_rows(spark: SparkSession, folder: str) -> DataFrame:
    return nft(spark, folder).groupBy("chain").agg(F.countDistinct("contract").alias("contracts"), F.count(F.lit(1)).alias("nfts"), F.countDistinct("token_uri").alias("uris"))


@query("a7_document_frequency", "SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY term")
def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")
    return metadata.terms(docs).groupBy("term").agg(F.countDistinct("doc").alias("df"))


@query("a8_term_frequency", "SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL")
def term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return metadata.terms(table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query("a20_mergeable_sets", M + " SELECT chain, len(list_distinct(flatten(list(d)))) AS addresses FROM (SELECT chain, contract, list(DISTINCT dst) AS d FROM moves GROUP BY ALL) GROUP BY chain")
def mergeable_sets(spark: SparkSession, folder: str) -> DataFrame:
    # sets merge as rows: distinct members per part, then over the parts
    part = moves(spark, folder).select("chain", "contract", "dst").distinct()
    return part.groupBy("chain").agg(F.countDistinct("dst").alias("addresses"))


@query("w3_overlap_rank", N + DQ.SEEDS_SQL + ", c AS (SELECT a.seed_chain, a.seed_contract, b.chain, b.contract, count(*) AS n FROM (SELECT DISTINCT seed_chain, seed_contract, token_id FROM seeds JOIN nft ON chain = seed_chain AND contract = seed_contract) a JOIN (SELECT DISTINCT chain, contract, token_id FROM nft) b USING (token_id) WHERE b.chain <> seed_chain OR b.contract <> seed_contract GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY seed_chain, seed_contract ORDER BY n DESC, chain, contract) AS rank FROM c")
def overlap_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts by how many token ids they share with each seed. The seeds are the stated query set."""
    own = nft(spark, folder).select("chain", "contract", "token_id").distinct()
    seed = own.join(DQ.seeds(spark, folder), ["chain", "contract"], "left_semi").select(F.col("chain").alias("seed_chain"), F.col("contract").alias("seed_contract"), "token_id")
    c = own.join(seed, "token_id").where("chain != seed_chain or contract != seed_contract").groupBy("seed_chain", "seed_contract", "chain", "contract").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("seed_chain", "seed_contract").orderBy(F.col("n").desc(), "chain", "contract")).cast("long"))


@query("w7_rare_terms", "WITH t AS (SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1), r AS (SELECT doc, term, row_number() OVER (PARTITION BY doc ORDER BY df, term) AS rn FROM t JOIN f USING (term)) SELECT doc, term FROM r WHERE rn <= 8")
def rare_terms(spark: SparkSession, folder: str) -> DataFrame:
    return extra.rare_terms(metadata.terms(table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")), 8)


@query("w9_event_order", M + " SELECT event_id, row_number() OVER (PARTITION BY chain, contract ORDER BY ts, event_id) AS place FROM moves")
def event_order(spark: SparkSession, folder: str) -> DataFrame:
    return moves(spark, folder).select("event_id", F.row_number().over(Window.partitionBy("chain", "contract").orderBy("ts", "event_id")).cast("long").alias("place"))


@query("f5_overlap_bounds", "WITH l AS (SELECT unnest(range(1, 33)) AS n), o AS (SELECT a.n AS n, b.n AS m, unnest(range(0, least(a.n, b.n) + 1)) AS k FROM l a, l b), j AS (SELECT n, m, k, (k * 1.0::DOUBLE / n + k * 1.0::DOUBLE / m + 1) / 3 AS jaro FROM o), s AS (SELECT n, m, k, CASE WHEN k = 0 THEN 0.0 WHEN jaro > 0.7 THEN least(1.0, jaro + 0.1 * least(k, 4) * (1 - jaro)) ELSE jaro END AS best FROM j) SELECT CAST(n AS INT) AS n, CAST(m AS INT) AS m, CAST(coalesce(min(k) FILTER (best >= 0.95 - 1e-12), n + m + 1) AS INT) AS least, arg_max(best, k) AS best FROM s GROUP BY n, m")
def overlap_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """n, m, least: letters that names of two lengths must share for a similarity of 0.95 (lengths up to 32)."""
    rows = [(n, m, least_overlap(n, m, 0.95), float(best_from_overlap(n, m, min(n, m)))) for n in range(1, 33) for m in range(1, 33)]
    return spark.createDataFrame(rows, "n int, m int, least int, best double")


@query("f6_letter_tokens", "SELECT n_nationkey, len(string_split(n_name, '')) AS letters, len(list_distinct(string_split(n_name, ''))) AS different FROM nation")
def letter_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = letter_tokens(F.col("n_name"))
    return table(spark, folder, "nation").select("n_nationkey", F.size(F.array_distinct(t)).cast("long").alias("letters"), F.size(F.filter(t, lambda x: x.endswith("1"))).cast("long").alias("different"))


@query("f14_elapsed", M + " SELECT chain, contract, min(ts) FILTER (is_sale) - min(ts) AS seconds FROM moves GROUP BY ALL")
def elapsed(spark: SparkSession, folder: str) -> DataFrame:
    return moves(spark, folder).groupBy("chain", "contract").agg((F.min(F.when(F.col("is_sale"), F.col("ts"))) - F.min("ts")).alias("seconds"))


@query("f15_bm25_weight", f"SELECT l_orderkey, l_linenumber, round(ln(2.0) * l_quantity * {K1 + 1} / (l_quantity + {K1} * (1 - {B} + {B} * 100.0 / 80.0)), 6) AS weight FROM lineitem")
def bm25_weight(spark: SparkSession, folder: str) -> DataFrame:
    from tessera.functions.similarity import IDF_ONCE, weight

    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(weight(F.col("l_quantity"), F.lit(100.0), F.lit(80.0), IDF_ONCE), 6).alias("weight"))


@query("d12_metadata_scopes", N + DQ.HITS_SQL + """, s AS (SELECT 'intra' AS scope, chain, peer, contract, member, nfts FROM mh WHERE peer = chain UNION ALL SELECT 'matrix', chain, peer, contract, member, nfts FROM mh WHERE peer <> chain
  UNION ALL SELECT DISTINCT 'cross', chain, '', contract, member, nfts FROM mh WHERE peer <> chain) SELECT scope, chain, peer, count(DISTINCT contract) AS contracts, CAST(sum(nfts) AS BIGINT) AS nfts FROM s GROUP BY ALL""")
def metadata_scopes(spark: SparkSession, folder: str) -> DataFrame:
    return names.name_scopes(metadata.metadata_hits(nft(spark, folder), 0.6).withColumnRenamed("member", "name"))


@query("d15_seed_metadata", N + DQ.PAIRED_SQL.replace("{threshold}", "0.2") + """, x2 AS (SELECT l AS seed, r AS other FROM mt UNION ALL SELECT r, l FROM mt) SELECT DISTINCT seed, other FROM x2 WHERE seed LIKE '%/src1%'""")
def seed_metadata(spark: SparkSession, folder: str) -> DataFrame:
    rows = nft(spark, folder)
    own = materialise(metadata.anchors(metadata.numbered(rows), "doc", "doc"), "metadata-anchors")
    seeds = materialise(own.where("contract LIKE '%/src1%'").select("contract").distinct(), "seeds")
    return metadata.seed_pairs(rows, own, 0.2, seeds).select(F.col("left").alias("seed"), F.col("right").alias("other"))


@query("d16_seed_overlay", N + DQ.SEEDS_SQL + " SELECT chain, contract, token_id, CASE WHEN EXISTS (SELECT 1 FROM seeds WHERE seed_chain = chain AND seed_contract = contract) THEN 'live' ELSE 'snapshot' END AS origin, count(*) AS n FROM nft GROUP BY ALL")
def seed_overlay(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder).select("chain", "contract", "token_id", "row_order").withColumn("origin", F.lit("snapshot"))
    live = own.join(DQ.seeds(spark, folder), ["chain", "contract"], "left_semi").withColumn("origin", F.lit("live"))
    return extra.overlay(own, live, ["chain", "contract", "token_id"]).groupBy("chain", "contract", "token_id", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("d19_corpus_bm25", N + DQ.SEEDS_SQL + f""", r AS (SELECT *, row_number() OVER (PARTITION BY chain, contract ORDER BY length(token_id) DESC, token_id DESC, row_order DESC) AS rn FROM nft), d AS (SELECT chain || '/' || contract AS doc, body FROM r WHERE rn = 1),
  t AS (SELECT doc, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+')) AS term FROM d) GROUP BY ALL), l AS (SELECT doc, sum(tf) AS len FROM t GROUP BY doc), c AS (SELECT avg(len) AS mean, count(*) AS n FROM l),
  f AS (SELECT term, count(*) AS df FROM t GROUP BY 1), q AS (SELECT doc AS query, term FROM t WHERE doc LIKE '%/src0-%')
  SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * len / mean))), 4) AS score FROM q JOIN t USING (term) JOIN f USING (term) JOIN l USING (doc), c WHERE doc <> query GROUP BY query, doc""")
def corpus_bm25(spark: SparkSession, folder: str) -> DataFrame:
    docs = DQ.top_documents(spark, folder)
    seeds = docs.where("doc LIKE '%/src0-%'").select(F.col("doc").alias("query"))
    return extra.corpus_scores(metadata.terms(docs), seeds).select("query", "doc", F.round("score", 4).alias("score"))


@query("d20_token_recheck", N + DQ.SEEDS_SQL + ", a AS (SELECT chain, contract, token_id, arg_min(name_norm, row_order) AS m FROM nft GROUP BY ALL) SELECT s.seed_chain, s.seed_contract, b.chain, b.contract, min(b.token_id) AS token_id FROM seeds s JOIN a ON a.chain = s.seed_chain AND a.contract = s.seed_contract JOIN a b ON b.token_id = a.token_id AND jaro_winkler_similarity(b.m, a.m) >= 0.65 AND (b.chain <> a.chain OR b.contract <> a.contract) GROUP BY ALL")
def token_recheck(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder).groupBy("chain", "contract", "token_id").agg(F.min_by("name_norm", "row_order").alias("m"))
    seed = own.join(DQ.seeds(spark, folder), ["chain", "contract"], "left_semi").select(F.col("chain").alias("seed_chain"), F.col("contract").alias("seed_contract"), "token_id", F.col("m").alias("seed_name"))
    near = own.join(seed, "token_id").where("chain != seed_chain OR contract != seed_contract").where(jaro_winkler_udf("m", "seed_name") >= 0.65)
    return near.groupBy("seed_chain", "seed_contract", "chain", "contract").agg(F.min("token_id").alias("token_id"))


@query("d22_sketch64", "WITH t AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL), h AS (SELECT doc, tf, CAST('0x' || substr(md5(term), 1, 16) AS UBIGINT) AS h FROM t), b AS (SELECT doc, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN tf ELSE -tf END) AS s FROM h, (SELECT unnest(range(64))::UTINYINT AS i) GROUP BY doc, i), u AS (SELECT doc, sum(CASE WHEN s > 0 THEN (1::UHUGEINT << i)::HUGEINT ELSE 0 END) AS v FROM b GROUP BY doc) SELECT doc, CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS sketch FROM u")
def sketch(spark: SparkSession, folder: str) -> DataFrame:
    return extra.sketch64(metadata.terms(table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")))


@query("g6_campaigns", "WITH RECURSIVE " + MOVES_SQL + """, v AS (SELECT DISTINCT contract, owner AS ev FROM holders), e AS (SELECT DISTINCT a.contract AS a, b.contract AS b FROM v a JOIN v b USING (ev) WHERE a.contract <> b.contract), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
  SELECT a AS contract, least(a, min(b)) AS campaign FROM r GROUP BY a""")
def campaigns(spark: SparkSession, folder: str) -> DataFrame:
    return extra.campaigns(behavior.holders(moves(spark, folder)).select("contract", F.col("owner").cast("string").alias("evidence")))


@query("g8_signals", M + """, t AS (SELECT * FROM moves WHERE NOT is_sale), p AS (SELECT DISTINCT chain, contract, src, dst FROM t), b AS (SELECT x.chain, x.contract, count(*) AS n FROM p x JOIN p y ON x.chain = y.chain AND x.contract = y.contract AND x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst GROUP BY ALL),
  o AS (SELECT chain, contract, src AS address, count(*) AS o FROM p GROUP BY ALL), i AS (SELECT chain, contract, dst AS address, count(*) AS i FROM t GROUP BY ALL), s AS (SELECT chain, contract, count(*) AS n FROM o LEFT JOIN i USING (chain, contract, address) WHERE o >= 3 AND coalesce(i, 0) <= 1 GROUP BY ALL)
  SELECT t.chain, t.contract, count(DISTINCT t.dst) AS receivers, coalesce(any_value(b.n), 0) AS reciprocal, coalesce(any_value(s.n), 0) AS stars, max(t.ts) - min(t.ts) AS delay, max(t.ts) - min(t.ts) BETWEEN 1 AND 86400 AS fast_spread FROM t LEFT JOIN b ON b.chain = t.chain AND b.contract = t.contract LEFT JOIN s ON s.chain = t.chain AND s.contract = t.contract GROUP BY t.chain, t.contract""")
def signals(spark: SparkSession, folder: str) -> DataFrame:
    return extra.signals(behavior.transfers_of(moves(spark, folder)))


@query("e5_honest_buyers", M + " SELECT s.chain, s.contract, s.dst AS address, count(*) AS buys, round(sum(usd), 4) AS paid FROM sales s JOIN roles r ON r.chain = s.chain AND r.contract = s.contract AND r.address = s.dst AND r.role = 'victim' GROUP BY ALL")
def honest_buyers(spark: SparkSession, folder: str) -> DataFrame:
    m, _, role = BQ.parts(spark, folder)
    return behavior.sales_of(m).join(role.where("role = 'victim'").withColumnRenamed("address", "dst"), ["chain", "contract", "dst"], "left_semi").groupBy("chain", "contract", F.col("dst").alias("address")).agg(F.count(F.lit(1)).alias("buys"), F.round(F.sum("usd"), 4).alias("paid"))


@query("e18_weak_labels", M + ", q AS (SELECT chain, contract, count(*) FILTER (role = 'operator') AS o, count(*) FILTER (role = 'victim') AS v FROM roles GROUP BY ALL), g AS (SELECT chain, contract, sum(coalesce(usd, 0)) AS usd FROM moves GROUP BY ALL) SELECT chain, contract, CASE WHEN o / (o + v) >= 0.99 AND usd > 0 THEN 'likely_malicious' WHEN v > 0 THEN 'has_victims' ELSE 'unknown' END AS label FROM q JOIN g USING (chain, contract)")
def weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    return extra.weak_labels(BQ.value_flow(spark, folder))


@query("e21_output_input", M + BQ.GAS_SQL + ", c AS (SELECT chain, contract, sum(gas) AS gas FROM gas GROUP BY ALL), o AS (SELECT s.chain, s.contract, sum(usd) AS out FROM sales s JOIN roles r ON r.chain = s.chain AND r.contract = s.contract AND r.address = s.src AND r.role = 'operator' GROUP BY ALL), x AS (SELECT coalesce(out, 0) / gas AS ratio FROM c LEFT JOIN o USING (chain, contract) WHERE gas > 0) SELECT count(*) AS contracts, count(*) FILTER (ratio >= 1) AS gain, count(*) FILTER (ratio < 1) AS loss, round(avg(ratio), 6) AS mean FROM x")
def output_input(spark: SparkSession, folder: str) -> DataFrame:
    m, held_, role = BQ.parts(spark, folder)
    gas = m.groupBy("chain", "contract").agg(F.sum(F.coalesce("usd", F.lit(1.0))).alias("gas")).where("gas > 0")
    x = gas.join(economics.exposure(m, role, held_), ["chain", "contract"]).select((F.col("operator_output_usd") / F.col("gas")).alias("ratio"))
    return x.agg(F.count(F.lit(1)).alias("contracts"), F.count(F.when(F.col("ratio") >= 1, 1)).alias("gain"), F.count(F.when(F.col("ratio") < 1, 1)).alias("loss"), F.round(F.avg("ratio"), 6).alias("mean"))


@query("e22_candidate_filter", N + DQ.SEEDS_SQL + " SELECT DISTINCT chain, contract FROM nft WHERE NOT EXISTS (SELECT 1 FROM seeds WHERE seed_chain = chain AND seed_contract = contract)")
def candidate_filter(spark: SparkSession, folder: str) -> DataFrame:
    return nft(spark, folder).select("chain", "contract").distinct().join(DQ.seeds(spark, folder), ["chain", "contract"], "left_anti")


@query("r4_seed_counts", N + DQ.SEED_URI_SQL + ", l AS (SELECT seed_chain, seed_contract FROM seeds UNION ALL SELECT 'base', 'absent'), d AS (SELECT DISTINCT seed_chain, seed_contract FROM su) SELECT (SELECT count(*) FROM l) AS selected, (SELECT count(*) FROM seeds) AS included, (SELECT count(*) FROM d) AS with_duplicate, round((SELECT count(*) FROM d) / (SELECT count(*) FROM seeds), 6) AS ratio")
def seed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds of the list, those that the snapshot has, those with a duplicate, and the ratio of the last two."""
    own = nft(spark, folder)
    listed = DQ.seeds(spark, folder).unionByName(spark.createDataFrame([("base", "absent")], "chain string, contract string"))
    there = own.select("chain", "contract").distinct().withColumn("there", F.lit(1))
    hits = DQ.seed_uri(spark, folder).select(F.col("seed_chain").alias("chain"), F.col("seed_contract").alias("contract")).distinct().withColumn("hit", F.lit(1))
    both = listed.join(there, ["chain", "contract"], "left").join(hits, ["chain", "contract"], "left")
    return both.agg(F.count(F.lit(1)).alias("selected"), F.count("there").alias("included"), F.count("hit").alias("with_duplicate"), F.round(F.try_divide(F.count("hit"), F.count("there")), 6).alias("ratio"))
