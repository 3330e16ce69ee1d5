"""Queries of scans, names, URIs and metadata over the ``nft`` view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.canonical import canonical_json, json_tokens
from tessera.functions.similarity import jaro_winkler_udf
from tessera.operators import metadata, names, snapshot, uri
from tessera.plans.registry import query
from tessera.runtime import materialise
from tessera.sources.fixtures import NFT_SQL, nft, table

W = "WITH " + NFT_SQL

TOKEN_SCOPES_SQL = """
  SELECT 'intra' AS scope, a.chain, a.chain AS peer, a.contract, a.row_order FROM nft a
  WHERE EXISTS (SELECT 1 FROM nft b WHERE b.{u} = a.{u} AND b.chain = a.chain AND b.contract <> a.contract)
  UNION ALL
  SELECT 'cross', a.chain, '', a.contract, a.row_order FROM nft a WHERE EXISTS (SELECT 1 FROM nft b WHERE b.{u} = a.{u} AND b.chain <> a.chain)
  UNION ALL
  SELECT DISTINCT 'matrix', a.chain, b.chain, a.contract, a.row_order FROM nft a JOIN nft b ON b.{u} = a.{u} AND b.chain <> a.chain"""
COUNT_SQL = "SELECT scope, chain, peer, count(DISTINCT contract) AS contracts, count(*) AS nfts FROM hits GROUP BY ALL"
TOTALS_SQL = "totals AS (SELECT chain, count(DISTINCT contract) AS total_contracts, count(*) AS total_nfts FROM nft GROUP BY chain)"


@query("s1_snapshot_scan", W + " SELECT chain, contract, token_id, regexp_replace(name_norm, '^\\s+|\\s+$', '', 'g') AS name_norm, token_uri, image_uri, row_order FROM nft")
def snapshot_scan(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.normalised(nft(spark, folder)).select("chain", "contract", "token_id", "name_norm", "token_uri", "image_uri", "row_order")


@query("s2_chain_allow_list", W + " SELECT chain, contract, count(*) AS nfts FROM nft WHERE chain IN ('ethereum', 'solana') GROUP BY ALL")
def chain_allow_list(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.allowed(nft(spark, folder), ["Ethereum ", "solana"]).groupBy("chain", "contract").agg(F.count(F.lit(1)).alias("nfts"))


@query("s3_two_pass_load", W + ", shared AS (SELECT token_uri FROM nft GROUP BY 1 HAVING count(DISTINCT chain || contract) > 1) SELECT chain, contract, CAST(sum(length(body)) AS BIGINT) AS chars FROM nft n WHERE EXISTS (SELECT 1 FROM nft m JOIN shared USING (token_uri) WHERE m.chain = n.chain AND m.contract = n.contract) GROUP BY ALL")
def two_pass_load(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder)
    return snapshot.second_pass(own, snapshot.contracts_that_matter(own)).groupBy("chain", "contract").agg(F.sum(F.length("body")).alias("chars"))


@query("s4_snapshot_import", W + ", r AS (SELECT *, row_number() OVER (PARTITION BY chain, contract, token_id ORDER BY length(body) DESC, token_uri, row_order) AS rn FROM nft) SELECT chain, contract, token_id, token_uri FROM r WHERE rn = 1")
def snapshot_import(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.best_rows(nft(spark, folder)).select("chain", "contract", "token_id", "token_uri")


@query("s6_seed_list", W + ", s AS (SELECT DISTINCT chain, contract FROM nft WHERE contract LIKE 'src0-%') SELECT chain, contract, CAST(row_number() OVER (ORDER BY chain, contract) AS INT) AS rank FROM s")
def seed_list(spark: SparkSession, folder: str) -> DataFrame:
    # the feature is a short list of seeds, ranked as a whole
    return snapshot.seed_list(nft(spark, folder).where("contract LIKE 'src0-%'").select("chain", "contract"))


@query("s7_population_cap", W + ", r AS (SELECT *, row_number() OVER (PARTITION BY chain, contract ORDER BY row_order) AS rn FROM nft) SELECT chain, contract, count(*) FILTER (rn <= 5) AS kept, count(*) > 5 AS capped FROM r GROUP BY ALL")
def population_cap(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.population(nft(spark, folder), 5).groupBy("chain", "contract").agg(F.count(F.lit(1)).alias("kept"), F.max("capped").alias("capped"))


@query("s14_fingerprint", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("s21_gateways", "SELECT page_id, unnest(['https://ipfs.io/ipfs/', 'https://dweb.link/ipfs/', 'https://cloudflare-ipfs.com/ipfs/']) || 'Qm' || md5(url) AS candidate FROM pages")
def gateways(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.explode(T.gateway_candidates(F.concat(F.lit("ipfs:Qm"), F.md5(F.col("url").cast("binary"))))).alias("candidate"))


@query("s22_clip", "SELECT doc_id, substr(text, 1, 64) AS clipped FROM documents")
def clip(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.clipped(F.col("text"), 64).alias("clipped"))


@query("a1_chain_totals", W + " SELECT chain, count(DISTINCT contract) AS contracts, count(*) AS nfts FROM nft GROUP BY chain")
def chain_totals(spark: SparkSession, folder: str) -> DataFrame:
    return uri.chain_totals(nft(spark, folder))


@query("a4_name_mode", W + ", c AS (SELECT chain, contract, name_norm, count(*) AS n FROM nft WHERE trim(name_norm) <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY chain, contract ORDER BY n DESC, name_norm) AS rn FROM c WHERE chain <> 'solana') SELECT chain, contract, name_norm AS name FROM r WHERE rn = 1")
def name_mode(spark: SparkSession, folder: str) -> DataFrame:
    return names.members(nft(spark, folder)).where("chain != 'solana'").select("chain", "contract", "name")


@query("a5_representatives", W + " SELECT chain, contract, arg_min(token_uri, row_order) FILTER (length(body) > 500) AS token_uri, arg_min(token_id, row_order) AS token_id FROM nft GROUP BY ALL")
def representatives(spark: SparkSession, folder: str) -> DataFrame:
    return nft(spark, folder).groupBy("chain", "contract").agg(F.min_by(F.when(F.length("body") > 500, F.col("token_uri")), F.when(F.length("body") > 500, F.col("row_order"))).alias("token_uri"), F.min_by("token_id", "row_order").alias("token_id"))


@query("a6_reason_bits", W + ", b AS (SELECT chain, contract, 1 AS bit FROM nft WHERE token_uri IN (SELECT token_uri FROM nft GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT chain, contract, 2 FROM nft WHERE image_uri IN (SELECT image_uri FROM nft GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT chain, contract, 4 FROM nft WHERE name_norm IN (SELECT name_norm FROM nft GROUP BY 1 HAVING count(*) > 1)) SELECT chain, contract, bit_or(bit) AS reasons FROM b GROUP BY ALL")
def reason_bits(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder)
    parts = []
    for column, bit in (("token_uri", 1), ("image_uri", 2), ("name_norm", 4)):
        often = own.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(column)
        parts.append(own.join(often, column, "left_semi").select("chain", "contract", F.lit(bit).alias("bit")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("chain", "contract").agg(F.bit_or("bit").alias("reasons"))


@query("a17_scope_rollup", W + ", hits AS (" + TOKEN_SCOPES_SQL.format(u="token_uri") + f"), {TOTALS_SQL}, c AS ({COUNT_SQL}) SELECT 'token_uri' AS dimension, scope, c.chain, peer, contracts, nfts, total_contracts, total_nfts, round(contracts / total_contracts, 6) AS contract_ratio, round(nfts / total_nfts, 6) AS nft_ratio FROM c JOIN totals USING (chain)")
def scope_rollup(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder)
    return uri.with_ratios(uri.token_uri_scopes(own), uri.chain_totals(own), F.lit("token_uri"))


@query("w1_best_rows", W + ", r AS (SELECT *, row_number() OVER (PARTITION BY chain, contract, token_id ORDER BY length(body) DESC, token_uri, row_order) AS rn FROM nft) SELECT chain, contract, token_id, image_uri FROM r WHERE rn = 1")
def best_rows(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.best_rows(nft(spark, folder)).select("chain", "contract", "token_id", "image_uri")


@query("w4_first_wins", W + " SELECT chain, contract, arg_min(token_uri, row_order) AS token_uri, arg_min(name_norm, row_order) FILTER (name_norm <> '') AS name_norm FROM nft GROUP BY chain, contract")
def first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.first_wins(nft(spark, folder), ["chain", "contract"], ["token_uri", "name_norm"], "row_order")


@query("w5_first_anchors", W + ", r AS (SELECT *, row_number() OVER (PARTITION BY chain, contract ORDER BY length(token_id), token_id, row_order) AS rn FROM nft) SELECT chain, contract, token_id, row_order FROM r WHERE rn <= 2")
def first_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.anchors(nft(spark, folder), 2).select("chain", "contract", "token_id", "row_order")


@query("w12_token_order", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY length(CAST(doc_id // 20 AS VARCHAR)), CAST(doc_id // 20 AS VARCHAR), doc_id) AS place FROM documents")
def token_order(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "documents").select("doc_id", "source", F.concat(F.lit("00"), F.expr("cast(doc_id div 20 as string)")).alias("token"))
    key = T.token_key(F.col("token"))
    return own.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(key["other"], key["digits"], key["text"], "doc_id")).cast("long").alias("place"))


@query("w14_pair_sample", W + ", f AS (SELECT token_uri, min(row_order) AS first, arg_min(contract, row_order) AS left_contract FROM nft GROUP BY 1), p AS (SELECT n.chain, f.left_contract, n.contract AS right_contract, n.token_uri, n.row_order, row_number() OVER (PARTITION BY n.chain ORDER BY md5('42|' || n.token_uri || '|' || n.row_order), n.token_uri, n.row_order) AS rn FROM nft n JOIN f ON f.token_uri = n.token_uri WHERE n.row_order <> f.first) SELECT * EXCLUDE (rn) FROM p WHERE rn <= 10")
def pair_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Ten duplicate pairs a chain, drawn by a seeded hash: repeatable, and without holding a reservoir."""
    own = nft(spark, folder)
    first = own.groupBy("token_uri").agg(F.min_by(F.struct("chain", "contract", "token_id"), "row_order").alias("a"), F.min("row_order").alias("first"))
    pairs = own.join(first, "token_uri").where("row_order != first").select("chain", F.col("a.contract").alias("left_contract"), F.col("contract").alias("right_contract"), "token_uri", "row_order")
    return snapshot.sample(pairs, ["chain"], ["token_uri", "row_order"], 10, seed=42)


@query("u1_union_all", W + " SELECT 'token_uri' AS kind, chain, token_uri AS uri, count(*) AS n FROM nft GROUP BY ALL UNION ALL SELECT 'image_uri', chain, image_uri, count(*) FROM nft GROUP BY ALL")
def union_all(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder)
    parts = [own.groupBy(F.lit(c).alias("kind"), "chain", F.col(c).alias("uri")).agg(F.count(F.lit(1)).alias("n")) for c in ("token_uri", "image_uri")]
    return parts[0].unionByName(parts[1])


@query("u2_set_union", W + " SELECT chain, contract FROM nft WHERE length(body) > 4000 UNION SELECT chain, contract FROM nft WHERE length(body) < 400")
def set_union(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder)
    return own.where(F.length("body") > 4000).select("chain", "contract").union(own.where(F.length("body") < 400).select("chain", "contract")).distinct()


@query("u3_image_minus_token", W + " SELECT row_order FROM nft a WHERE EXISTS (SELECT 1 FROM nft b WHERE b.image_uri = a.image_uri AND b.row_order <> a.row_order) AND NOT EXISTS (SELECT 1 FROM nft b WHERE b.token_uri = a.token_uri AND b.row_order <> a.row_order)")
def image_minus_token(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder)
    often = {c: own.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c) for c in ("image_uri", "token_uri")}
    return own.join(often["image_uri"], "image_uri", "left_semi").join(often["token_uri"], "token_uri", "left_anti").select("row_order")


@query("u4_intersection", W + " SELECT chain, contract FROM nft WHERE length(body) > 4000 INTERSECT SELECT chain, contract FROM nft WHERE length(body) < 400")
def intersection(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder)
    return own.where(F.length("body") > 4000).select("chain", "contract").intersect(own.where(F.length("body") < 400).select("chain", "contract"))


@query("d1_token_uri", W + ", hits AS (" + TOKEN_SCOPES_SQL.format(u="token_uri") + ") " + COUNT_SQL)
def token_uri(spark: SparkSession, folder: str) -> DataFrame:
    return uri.token_uri_scopes(nft(spark, folder))


@query(
    "d2_image_uri",
    W
    + """, f AS (SELECT a.*, EXISTS (SELECT 1 FROM nft b WHERE b.token_uri = a.token_uri AND b.chain = a.chain AND b.contract <> a.contract) AS intra_hit,
      EXISTS (SELECT 1 FROM nft b WHERE b.token_uri = a.token_uri AND b.chain <> a.chain) AS cross_hit FROM nft a),
    ch AS (SELECT DISTINCT chain AS peer FROM nft),
    m AS (SELECT a.*, ch.peer FROM nft a JOIN ch ON ch.peer <> a.chain WHERE NOT EXISTS (SELECT 1 FROM nft b WHERE b.token_uri = a.token_uri AND b.chain = ch.peer)),
    hits AS (
      SELECT 'intra' AS scope, chain, chain AS peer, contract, row_order FROM f a WHERE NOT intra_hit AND EXISTS (SELECT 1 FROM f b WHERE NOT b.intra_hit AND b.image_uri = a.image_uri AND b.chain = a.chain AND b.contract <> a.contract)
      UNION ALL SELECT 'cross', chain, '', contract, row_order FROM f a WHERE NOT cross_hit AND EXISTS (SELECT 1 FROM f b WHERE NOT b.cross_hit AND b.image_uri = a.image_uri AND b.chain <> a.chain)
      UNION ALL SELECT 'matrix', chain, peer, contract, row_order FROM m a WHERE EXISTS (SELECT 1 FROM m b WHERE b.image_uri = a.image_uri AND b.chain = a.peer AND b.peer = a.chain)) """
    + COUNT_SQL,
)
def image_uri(spark: SparkSession, folder: str) -> DataFrame:
    return uri.image_uri_scopes(nft(spark, folder))


MEMBERS_SQL = """, size AS (SELECT chain, contract, count(*) AS nfts FROM nft GROUP BY ALL),
c AS (SELECT chain, contract, name_norm AS name, count(*) AS n FROM nft WHERE trim(name_norm) <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY chain, contract ORDER BY n DESC, name) AS rn FROM c WHERE chain <> 'solana'),
members AS (SELECT chain, contract, name, 1 AS members, nfts FROM r JOIN size USING (chain, contract) WHERE rn = 1 UNION ALL SELECT chain, contract, name, n, n FROM c WHERE chain = 'solana')"""
NAME_SCOPES_SQL = """, hits AS (SELECT DISTINCT chain, contract, name, nfts, peer FROM near),
s AS (SELECT 'intra' AS scope, chain, peer, contract, name, nfts FROM hits WHERE peer = chain UNION ALL SELECT 'matrix', chain, peer, contract, name, nfts FROM hits WHERE peer <> chain
      UNION ALL SELECT DISTINCT 'cross', chain, '', contract, name, nfts FROM hits WHERE peer <> chain)
SELECT scope, chain, peer, count(DISTINCT contract) AS contracts, CAST(sum(nfts) AS BIGINT) AS nfts FROM s GROUP BY ALL"""
EXACT_SQL = "SELECT a.chain, a.contract, a.name, a.nfts, b.chain AS peer FROM members a JOIN members b ON a.name = b.name AND (a.chain <> b.chain OR a.contract <> b.contract OR a.members > 1)"


@query("d3_exact_names", W + MEMBERS_SQL + ", near AS (" + EXACT_SQL + ")" + NAME_SCOPES_SQL)
def exact_names(spark: SparkSession, folder: str) -> DataFrame:
    return names.name_scopes(names.exact_hits(names.members(nft(spark, folder))))


@query("d4_fuzzy_names", W + MEMBERS_SQL + ", near AS (" + EXACT_SQL + " UNION ALL SELECT a.chain, a.contract, a.name, a.nfts, b.chain FROM members a JOIN members b ON a.name <> b.name AND jaro_winkler_similarity(a.name, b.name) >= 0.95)" + NAME_SCOPES_SQL)
def fuzzy_names(spark: SparkSession, folder: str) -> DataFrame:
    own = names.members(nft(spark, folder))
    return names.name_scopes(names.fuzzy_hits(own, 0.95))


@query("d5_name_members", W + MEMBERS_SQL + " SELECT chain, contract, name, CAST(members AS BIGINT) AS members, nfts FROM members")
def name_members(spark: SparkSession, folder: str) -> DataFrame:
    return names.members(nft(spark, folder))


@query("j6_similar_names", W + ", n AS (SELECT DISTINCT name_norm AS name FROM nft WHERE trim(name_norm) <> '') SELECT a.name AS \"left\", b.name AS \"right\", round(jaro_winkler_similarity(a.name, b.name), 6) AS score FROM n a JOIN n b ON a.name < b.name AND jaro_winkler_similarity(a.name, b.name) >= 0.93")
def similar_names(spark: SparkSession, folder: str) -> DataFrame:
    own = nft(spark, folder).where(T.usable_name(F.col("name_norm"))).select(F.col("name_norm").alias("name"))
    return names.similar_names(own, 0.93).select("left", "right", F.round("score", 6).alias("score"))


@query("d6_canonical_json", "SELECT p_partkey, '{\"a\":\"' || lower(p_brand) || '\",\"attributes\":[{\"trait_type\":\"a\",\"value\":1.5},{\"trait_type\":\"t\",\"value\":2}],\"b\":' || p_size || '}' AS canonical FROM part")
def canonical(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.lit('{"b": '), F.col("p_size").cast("string"), F.lit(', "a": "'), F.upper("p_brand"), F.lit('", "attributes": [{"trait_type": "T", "value": 2}, {"trait_type": "A", "value": 1.50}]}'))
    return table(spark, folder, "part").select("p_partkey", canonical_json(raw).alias("canonical"))


@query("d7_metadata_tokens", "SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)")
def metadata_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = json_tokens(F.lower("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(tokens).cast("long").alias("tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("terms"))


TOP_SQL = W + """, r AS (SELECT *, row_number() OVER (PARTITION BY chain, contract ORDER BY length(token_id) DESC, token_id DESC, row_order DESC) AS rn FROM nft),
d AS (SELECT chain || '/' || contract AS doc, body FROM r WHERE rn = 1),
w AS (SELECT doc, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')) AS term FROM d),
t AS (SELECT doc, term, CAST(count(*) AS DOUBLE) AS tf FROM w GROUP BY ALL), l AS (SELECT doc, sum(tf) AS len FROM t GROUP BY doc),
p AS (SELECT a.doc AS "left", b.doc AS "right", a.len AS ll, b.len AS rl, (a.len + b.len) / 2 AS avg FROM l a JOIN l b ON a.doc < b.doc),
x AS (SELECT p."left", p."right", t.term, t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * ll / greatest(avg, 1))) AS lw FROM p JOIN t ON t.doc = p."left"),
y AS (SELECT p."left", p."right", t.term, t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * rl / greatest(avg, 1))) AS rw FROM p JOIN t ON t.doc = p."right"),
z AS (SELECT coalesce(x."left", y."left") AS "left", coalesce(x."right", y."right") AS "right", coalesce(lw, 0) * CASE WHEN rw IS NULL THEN ln(2.0) ELSE ln(1.2) END AS lw, coalesce(rw, 0) * CASE WHEN lw IS NULL THEN ln(2.0) ELSE ln(1.2) END AS rw
      FROM x FULL JOIN y ON x."left" = y."left" AND x."right" = y."right" AND x.term = y.term),
s AS (SELECT "left", "right", sum(lw * rw) / sqrt(sum(lw * lw) * sum(rw * rw)) AS score FROM z GROUP BY ALL)
"""


def top_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc, text: the metadata of the largest token of each contract."""
    key = F.struct(F.length("token_id"), F.col("token_id"), F.col("row_order"))
    return nft(spark, folder).groupBy(F.concat("chain", F.lit("/"), "contract").alias("doc")).agg(F.max_by("body", key).alias("text"))


#: Scores of pairs ``dp`` (a, b) of documents ``txt`` (doc, body), from the definition.
SCORE_SQL = """, tm AS (SELECT doc, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')) AS term FROM txt) GROUP BY ALL),
ln AS (SELECT doc, sum(tf) AS len FROM tm GROUP BY doc),
pl AS (SELECT a, b, x.len AS ll, y.len AS rl, (x.len + y.len) / 2 AS mean FROM dp JOIN ln x ON x.doc = a JOIN ln y ON y.doc = b),
lw AS (SELECT a, b, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ll / greatest(mean, 1))) AS w FROM pl JOIN tm ON doc = a),
rw AS (SELECT a, b, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * rl / greatest(mean, 1))) AS w FROM pl JOIN tm ON doc = b),
both_w AS (SELECT coalesce(lw.a, rw.a) AS a, coalesce(lw.b, rw.b) AS b, coalesce(lw.w, 0) * CASE WHEN rw.w IS NULL THEN ln(2.0) ELSE ln(1.2) END AS x, coalesce(rw.w, 0) * CASE WHEN lw.w IS NULL THEN ln(2.0) ELSE ln(1.2) END AS y
  FROM lw FULL JOIN rw ON lw.a = rw.a AND lw.b = rw.b AND lw.term = rw.term),
sc AS (SELECT a, b, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS score FROM both_w GROUP BY ALL)"""
#: Members, their chosen documents, and ``mt``: pairs of members (l, r) that match at the threshold.
PAIRED_SQL = """, anc AS (SELECT chain, chain || '/' || contract || CASE WHEN chain = 'solana' THEN '/' || token_id ELSE '' END AS member, chain || '/' || contract AS contract, token_id, arg_max(body, row_order) AS body, count(*) AS nfts FROM nft GROUP BY ALL),
txt AS (SELECT body, row_number() OVER (ORDER BY body) AS doc FROM (SELECT DISTINCT body FROM anc)), ad AS (SELECT anc.*, doc FROM anc JOIN txt USING (body)),
tp AS (SELECT member, any_value(chain) AS chain, any_value(contract) AS contract, CAST(sum(nfts) AS BIGINT) AS nfts, arg_max(doc, (length(token_id), token_id)) AS doc FROM ad GROUP BY member),
pr AS (SELECT x.member AS l, y.member AS r, x.chain AS lc, y.chain AS rc, x.doc AS lt, y.doc AS rt FROM tp x JOIN tp y ON x.member < y.member AND x.contract <> y.contract),
sh AS (SELECT l, r, arg_max(x.doc, (length(x.token_id), x.token_id)) AS ld, arg_max(y.doc, (length(x.token_id), x.token_id)) AS rd FROM pr JOIN ad x ON x.member = l JOIN ad y ON y.member = r AND y.token_id = x.token_id WHERE lc <> 'solana' AND rc <> 'solana' GROUP BY ALL),
ch AS (SELECT pr.l, pr.r, lc, rc, coalesce(ld, lt) AS ld, coalesce(rd, rt) AS rd FROM pr LEFT JOIN sh ON sh.l = pr.l AND sh.r = pr.r),
dp AS (SELECT DISTINCT least(ld, rd) AS a, greatest(ld, rd) AS b FROM ch WHERE ld <> rd)""" + SCORE_SQL + """,
mt AS (SELECT l, r, lc, rc FROM ch LEFT JOIN sc ON a = least(ld, rd) AND b = greatest(ld, rd) WHERE ld = rd OR score >= {threshold})"""
HITS_SQL = PAIRED_SQL.replace("{threshold}", "0.6") + """, mh AS (SELECT DISTINCT member, tp.chain, tp.contract, nfts, peer FROM tp JOIN (SELECT l AS member, rc AS peer FROM mt UNION ALL SELECT r, lc FROM mt) USING (member))"""


def documents_(spark: SparkSession, folder: str) -> DataFrame:
    """doc, text of all rows; every tenth text is repeated under another number, so that there are copies on both sides of links."""
    own = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")
    return own.unionByName(own.where("doc % 10 = 3").select((F.col("doc") + 1_000_000_000).alias("doc"), "text"))


@query("d9_bm25_cosine", "WITH raw AS (SELECT doc_id AS doc, text FROM documents UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 10 = 3), txt AS (SELECT min(doc) AS doc, text AS body FROM raw GROUP BY text), dp AS (SELECT x.doc AS a, y.doc AS b FROM txt x JOIN txt y ON x.doc < y.doc)" + SCORE_SQL + " SELECT 'pair' AS kind, a AS \"left\", b AS \"right\", round(score, 4) AS score FROM sc WHERE score >= 0.6 UNION ALL SELECT 'member', raw.doc, txt.doc, 1.0 FROM raw JOIN txt ON raw.text = txt.body")
def bm25_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of representatives and the membership of all documents, of which some are copies."""
    pairs, member = metadata.matches(documents_(spark, folder), 0.6)
    found = pairs.select(F.lit("pair").alias("kind"), "left", "right", F.round("score", 4).alias("score"))
    return found.unionByName(member.select(F.lit("member").alias("kind"), F.col("doc").alias("left"), F.col("rep").alias("right"), F.lit(1.0).alias("score")))


@query("j11_all_pairs", "WITH txt AS (SELECT n_nationkey AS doc, n_name AS body FROM nation), dp AS (SELECT x.doc AS a, y.doc AS b FROM txt x JOIN txt y ON x.doc < y.doc)" + SCORE_SQL + " SELECT a AS \"left\", b AS \"right\", round(score, 4) AS score FROM sc")
def all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A threshold of 0 asks for the full cross product."""
    docs = table(spark, folder, "nation").select(F.col("n_nationkey").alias("doc"), F.col("n_name").alias("text"))
    return metadata.matches(docs, 0.0)[0].select("left", "right", F.round("score", 4).alias("score"))


@query("d10_identical_metadata", W + ", f AS (SELECT md5(body) AS m, min(row_order) AS first, count(*) AS n, count(DISTINCT chain || contract) AS contracts FROM nft GROUP BY 1) SELECT first, n, contracts FROM f WHERE n > 1")
def identical_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return nft(spark, folder).groupBy(F.sha2(F.col("body").cast("binary"), 256).alias("m")).agg(F.min("row_order").alias("first"), F.count(F.lit(1)).alias("n"), F.countDistinct("chain", "contract").alias("contracts")).where("n > 1").select("first", "n", "contracts")


@query("d11_profiles", W + ", a AS (SELECT chain, contract, string_agg(md5(body), ',' ORDER BY row_order) AS profile, count(*) AS docs FROM nft GROUP BY ALL) SELECT count(*) AS contracts, min(chain || contract) AS first, any_value(docs) AS docs FROM a GROUP BY profile")
def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts with the same documents in the same order, told by their number and two sums of hashes: no list of a contract is made."""
    w = Window.partitionBy("chain", "contract").orderBy("row_order")
    own = nft(spark, folder).select("chain", "contract", F.row_number().over(w).alias("place"), F.md5(F.col("body").cast("binary")).alias("m"))
    one = own.groupBy("chain", "contract").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.xxhash64("place", "m").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("m", "place")).alias("x"))
    return one.groupBy("docs", "s", "x").agg(F.count(F.lit(1)).alias("contracts"), F.min(F.concat("chain", "contract")).alias("first")).select("contracts", "first", "docs")


SEEDS_SQL = ", seeds AS (SELECT DISTINCT chain AS seed_chain, contract AS seed_contract FROM nft WHERE contract LIKE 'src0-%')"


def seeds(spark: SparkSession, folder: str) -> DataFrame:
    return nft(spark, folder).where("contract LIKE 'src0-%'").select("chain", "contract").distinct()


SEED_URI_SQL = SEEDS_SQL + """, own AS (SELECT seed_chain, seed_contract, row_order AS seed_row, token_uri, image_uri FROM seeds JOIN nft ON chain = seed_chain AND contract = seed_contract),
te AS (SELECT DISTINCT seed_chain, seed_contract, own.token_uri, n.chain, n.contract, n.row_order, CASE WHEN n.chain = seed_chain THEN 'intra' ELSE 'cross' END AS scope FROM own JOIN nft n ON n.token_uri = own.token_uri WHERE n.chain <> seed_chain OR n.contract <> seed_contract),
ie AS (SELECT DISTINCT o.seed_chain, o.seed_contract, n.chain, n.contract, n.row_order, CASE WHEN n.chain = o.seed_chain THEN 'intra' ELSE 'cross' END AS scope FROM own o JOIN nft n ON n.image_uri = o.image_uri WHERE (n.chain <> o.seed_chain OR n.contract <> o.seed_contract)
  AND NOT EXISTS (SELECT 1 FROM te WHERE te.seed_chain = o.seed_chain AND te.seed_contract = o.seed_contract AND te.token_uri = o.token_uri AND te.scope = CASE WHEN n.chain = o.seed_chain THEN 'intra' ELSE 'cross' END)
  AND NOT EXISTS (SELECT 1 FROM te WHERE te.seed_chain = o.seed_chain AND te.seed_contract = o.seed_contract AND te.row_order = n.row_order AND te.scope = CASE WHEN n.chain = o.seed_chain THEN 'intra' ELSE 'cross' END)),
su AS (SELECT seed_chain, seed_contract, 'token_uri' AS kind, chain, contract, scope, count(DISTINCT row_order) AS nfts FROM te GROUP BY ALL UNION ALL SELECT seed_chain, seed_contract, 'image_uri', chain, contract, scope, count(DISTINCT row_order) FROM ie GROUP BY ALL)"""


@query("d13_seed_uri", W + SEED_URI_SQL + " SELECT * FROM su")
def seed_uri(spark: SparkSession, folder: str) -> DataFrame:
    return uri.seed_uri_hits(nft(spark, folder), seeds(spark, folder))


@query("d14_seed_names", W + MEMBERS_SQL + SEEDS_SQL + " SELECT DISTINCT seed_chain, seed_contract, b.chain, b.contract FROM seeds JOIN members a ON a.chain = seed_chain AND a.contract = seed_contract JOIN members b ON a.name = b.name WHERE b.chain <> seed_chain OR b.contract <> seed_contract")
def seed_names(spark: SparkSession, folder: str) -> DataFrame:
    own = names.members(nft(spark, folder)).select("chain", "contract", "name")
    mine = own.join(seeds(spark, folder), ["chain", "contract"]).select(F.col("chain").alias("seed_chain"), F.col("contract").alias("seed_contract"), "name").distinct()
    return own.join(mine, "name").where("chain != seed_chain OR contract != seed_contract").select("seed_chain", "seed_contract", "chain", "contract").distinct()


@query("w2_recall_cap", W + MEMBERS_SQL + SEED_URI_SQL + """, re AS (SELECT seed_chain, seed_contract, chain, contract, CASE kind WHEN 'token_uri' THEN 1 ELSE 2 END AS reason FROM su
  UNION ALL SELECT DISTINCT seed_chain, seed_contract, b.chain, b.contract, 3 FROM seeds JOIN members a ON a.chain = seed_chain AND a.contract = seed_contract JOIN members b ON a.name = b.name WHERE b.chain <> seed_chain OR b.contract <> seed_contract
  UNION ALL SELECT DISTINCT seed_chain, seed_contract, n.chain, n.contract, 4 FROM seeds JOIN nft o ON o.chain = seed_chain AND o.contract = seed_contract JOIN nft n ON n.token_id = o.token_id WHERE n.chain <> seed_chain OR n.contract <> seed_contract),
  be AS (SELECT seed_chain, seed_contract, chain, contract, min(reason) AS reason FROM re GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY seed_chain, seed_contract ORDER BY reason, chain, contract) AS rn FROM be) SELECT * EXCLUDE (rn) FROM rk WHERE rn <= 5""")
def recall_cap(spark: SparkSession, folder: str) -> DataFrame:
    """Each seed's first five candidates, ranked URI, image, name, token id: the cap is the feature, and the seeds the stated query set."""
    key = ["seed_chain", "seed_contract", "chain", "contract"]
    own, mine = nft(spark, folder), seeds(spark, folder)
    by_uri = seed_uri(spark, folder).select(*key, F.when(F.col("kind") == "token_uri", 1).otherwise(2).alias("reason"))
    by_name = seed_names(spark, folder).select(*key, F.lit(3).alias("reason"))
    token = own.join(mine, ["chain", "contract"], "left_semi").select(F.col("chain").alias("seed_chain"), F.col("contract").alias("seed_contract"), "token_id").distinct()
    by_token = own.select("chain", "contract", "token_id").distinct().join(token, "token_id").where("chain != seed_chain or contract != seed_contract").select(*key, F.lit(4).alias("reason"))
    best = by_uri.unionByName(by_name).unionByName(by_token).groupBy(*key).agg(F.min("reason").alias("reason"))
    w = Window.partitionBy("seed_chain", "seed_contract").orderBy("reason", "chain", "contract")
    return best.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query("d17_candidate_registry", W + MEMBERS_SQL + SEED_URI_SQL + PAIRED_SQL.replace("{threshold}", "0.6") + """, e AS (
  SELECT seed_chain, seed_contract, chain, contract, kind AS dim, false AS whole FROM su
  UNION SELECT DISTINCT seed_chain, seed_contract, b.chain, b.contract, 'name', true FROM seeds JOIN members a ON a.chain = seed_chain AND a.contract = seed_contract JOIN members b ON a.name = b.name WHERE b.chain <> seed_chain OR b.contract <> seed_contract
  UNION SELECT DISTINCT seed_chain, seed_contract, y.chain, split_part(y.contract, '/', 2), 'metadata', y.chain <> 'solana' FROM (SELECT l AS s, r AS o FROM mt UNION ALL SELECT r, l FROM mt) JOIN tp x ON x.member = s JOIN tp y ON y.member = o JOIN seeds ON x.contract = seed_chain || '/' || seed_contract)
SELECT seed_chain, seed_contract, chain, contract, string_agg(DISTINCT dim, ',' ORDER BY dim) AS dims, bool_or(whole) AS whole FROM e GROUP BY ALL""")
def candidate_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The dimensions in which a seed has a candidate, and whether one of them is of the whole contract."""
    key = ["seed_chain", "seed_contract", "chain", "contract"]
    mine = seeds(spark, folder)
    a = materialise(seed_uri(spark, folder).select(*key, F.col("kind").alias("dim"), F.lit(False).alias("whole")), "seed-uris")  # plans of their own: one of all dimensions is large
    b = seed_names(spark, folder).select(*key, F.lit("name").alias("dim"), F.lit(True).alias("whole"))
    rows = nft(spark, folder)
    own = materialise(metadata.anchors(metadata.numbered(rows), "doc", "doc"), "metadata-anchors")
    contracts = materialise(mine.select(F.concat("chain", F.lit("/"), "contract").alias("contract")), "seeds")
    probes = own.join(contracts, "contract", "left_semi").select("doc").distinct()
    links = materialise(metadata.numbered_links(rows, own, 0.6, probes), "seed-links")
    pairs = materialise(metadata.contract_pairs(own, links, contracts), "seed-pairs")

    def part(c: str, n: int):
        return F.split(c, "/")[n]

    c = pairs.select(part("left", 0).alias("seed_chain"), part("left", 1).alias("seed_contract"), part("right", 0).alias("chain"), part("right", 1).alias("contract"), F.lit("metadata").alias("dim"), (part("right", 0) != "solana").alias("whole"))
    return a.unionByName(b).unionByName(c).groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("dim")), ",").alias("dims"), F.bool_or("whole").alias("whole"))


D2_SQL = """, f AS (SELECT a.*, EXISTS (SELECT 1 FROM nft b WHERE b.token_uri = a.token_uri AND b.chain = a.chain AND b.contract <> a.contract) AS intra_hit,
      EXISTS (SELECT 1 FROM nft b WHERE b.token_uri = a.token_uri AND b.chain <> a.chain) AS cross_hit FROM nft a),
    pc AS (SELECT DISTINCT chain AS peer FROM nft),
    m AS (SELECT a.*, pc.peer FROM nft a JOIN pc ON pc.peer <> a.chain WHERE NOT EXISTS (SELECT 1 FROM nft b WHERE b.token_uri = a.token_uri AND b.chain = pc.peer))"""
IMAGE_SCOPES_SQL = """
      SELECT 'intra' AS scope, chain, chain AS peer, contract, row_order FROM f a WHERE NOT intra_hit AND EXISTS (SELECT 1 FROM f b WHERE NOT b.intra_hit AND b.image_uri = a.image_uri AND b.chain = a.chain AND b.contract <> a.contract)
      UNION ALL SELECT 'cross', chain, '', contract, row_order FROM f a WHERE NOT cross_hit AND EXISTS (SELECT 1 FROM f b WHERE NOT b.cross_hit AND b.image_uri = a.image_uri AND b.chain <> a.chain)
      UNION ALL SELECT 'matrix', chain, peer, contract, row_order FROM m a WHERE EXISTS (SELECT 1 FROM m b WHERE b.image_uri = a.image_uri AND b.chain = a.peer AND b.peer = a.chain)"""
MEMBER_SCOPES = "SELECT {k} AS kind, s.scope, s.chain, s.peer, n.contract, n.row_order FROM (SELECT 'intra' AS scope, h.chain, h.peer, h.contract, h.name FROM {h} h WHERE h.peer = h.chain UNION ALL SELECT 'matrix', h.chain, h.peer, h.contract, h.name FROM {h} h WHERE h.peer <> h.chain UNION ALL SELECT DISTINCT 'cross', h.chain, '', h.contract, h.name FROM {h} h WHERE h.peer <> h.chain) s JOIN nft n ON n.chain = s.chain AND n.contract = s.contract AND (n.chain <> 'solana' OR {on})"


@query(
    "d18_duplicate_scale",
    W + MEMBERS_SQL + HITS_SQL + D2_SQL + ", nh AS (SELECT DISTINCT chain, contract, name, peer FROM (" + EXACT_SQL + ")), eh AS (SELECT DISTINCT chain, split_part(contract, '/', 2) AS contract, split_part(member, '/', 3) AS name, peer FROM mh), every AS (SELECT 'token_uri' AS kind, * FROM ("
    + TOKEN_SCOPES_SQL.format(u="token_uri") + ") UNION ALL SELECT 'image_uri', * FROM (" + IMAGE_SCOPES_SQL + ") UNION ALL " + MEMBER_SCOPES.format(k="'name'", h="nh", on="n.name_norm = s.name") + " UNION ALL " + MEMBER_SCOPES.format(k="'metadata'", h="eh", on="n.token_id = s.name")
    + f"), {TOTALS_SQL}, kinds AS (SELECT * FROM every UNION ALL SELECT 'total', * EXCLUDE (kind) FROM every) SELECT kind, scope, chain, peer, count(DISTINCT contract) AS contracts, count(DISTINCT row_order) AS nfts, any_value(total_contracts) AS total_contracts, any_value(total_nfts) AS total_nfts, round(count(DISTINCT contract) / any_value(total_contracts), 6) AS contract_ratio, round(count(DISTINCT row_order) / any_value(total_nfts), 6) AS nft_ratio FROM kinds JOIN totals USING (chain) GROUP BY kind, scope, chain, peer",
)
def duplicate_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Rows token_uri, image_uri, name, metadata and total (the union of their NFTs) of every scope, with denominators."""
    own = nft(spark, folder)
    name = names.exact_hits(names.members(own)).select("chain", "contract", F.col("name").alias("which"), "peer")
    held = metadata.metadata_hits(own, 0.6).select("chain", F.split("contract", "/")[1].alias("contract"), F.get(F.split("member", "/"), F.lit(2)).alias("which"), "peer")

    def member(which: str):
        """What tells the members of a contract: nothing of an EVM contract, which is one."""
        return F.when(F.col("chain") == "solana", F.col(which)).otherwise(F.lit(""))

    def by_member(rows: DataFrame, hits: DataFrame, kind: str, which: str) -> DataFrame:
        """The rows with the (scope, peer) of their members' hits."""
        peers = hits.groupBy("chain", "contract", member("which").alias("member")).agg(F.collect_set("peer").alias("peers"))
        found = rows.withColumnRenamed(which, "member").join(materialise(peers, f"{kind}-hits"), ["chain", "contract", "member"], "left")
        peers = F.coalesce(F.col("peers"), F.array().cast("array<string>"))
        other = F.filter(peers, lambda p: p != F.col("chain"))
        return found.withColumn(f"{kind}_hits", uri.hit_scopes(F.array_contains(peers, F.col("chain")), F.size(other) > 0, other)).drop("member", "peers")

    rows = own.select("chain", "contract", "row_order", "token_uri", "image_uri", member("name_norm").alias("name_norm"), member("token_id").alias("token_id"))
    rows = uri.nft_hits(by_member(by_member(rows, name, "name", "name_norm"), held, "metadata", "token_id"))
    kinds = {"token_uri": "token_hits", "image_uri": "image_hits", "name": "name_hits", "metadata": "metadata_hits"}
    total = F.array_union(F.array_union("token_hits", "image_hits"), F.array_union("name_hits", "metadata_hits"))

    def of_kind(kind: str, hits):
        return F.transform(hits, lambda h: F.struct(F.lit(kind).alias("kind"), h["scope"].alias("scope"), h["peer"].alias("peer")))

    hits = F.concat(*(of_kind(kind, F.col(c)) for kind, c in kinds.items()), of_kind("total", total))
    every = materialise(rows.select("chain", "contract", "row_order", hits.alias("hits")).where(F.size("hits") > 0), "duplicate-nfts")
    key = ["kind", "scope", "chain", "peer"]
    contracts = every.select("chain", "contract", F.explode("hits").alias("h")).select("chain", "contract", "h.*").distinct().groupBy(*key).agg(F.count("contract").alias("contracts"), F.lit(0).cast("long").alias("nfts"))
    once = every.groupBy("chain", "row_order").agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"))
    nfts = once.select("chain", "row_order", F.explode("hits").alias("h")).select("chain", "row_order", "h.*").groupBy(*key).agg(F.lit(0).cast("long").alias("contracts"), F.count("row_order").alias("nfts"))
    counts = contracts.unionByName(nfts).groupBy(*key).agg(F.sum("contracts").alias("contracts"), F.sum("nfts").alias("nfts"))
    return uri.with_ratios(counts, uri.chain_totals(own), F.col("kind"), "kind")


@query("d24_name_canopy", "WITH n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT substr(name, 1, 3) AS p3, count(*) AS n FROM n GROUP BY 1) SELECT name, CASE WHEN s.n < 64 THEN p3 ELSE substr(name, 1, 5) || '|len' || (length(name) // 6) END AS block FROM n JOIN s ON substr(name, 1, 3) = p3")
def name_canopy(spark: SparkSession, folder: str) -> DataFrame:
    return names.canopy(table(spark, folder, "part").select(F.col("p_name").alias("name")).distinct())


@query("d25_clusters", W + ", n AS (SELECT DISTINCT name_norm AS name FROM nft WHERE trim(name_norm) <> ''), e AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name <> b.name AND jaro_winkler_similarity(a.name, b.name) >= 0.93), reach AS (SELECT DISTINCT x FROM (SELECT a AS x FROM e)) SELECT count(*) AS names FROM reach")
def clusters(spark: SparkSession, folder: str) -> DataFrame:
    pairs = similar_names(spark, folder)
    return snapshot.threshold_clusters(pairs).agg(F.count(F.lit(1)).alias("names"))


@query("d26_group_sizes", W + ", g AS (SELECT token_uri, count(*) AS n FROM nft GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (n >= 2) AS twice, count(*) FILTER (n > 2) AS more, round(100.0 * count(*) FILTER (n >= 2) / count(*), 4) AS percent FROM g")
def group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    g = nft(spark, folder).groupBy("token_uri").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count(F.when(F.col("n") >= 2, 1)).alias("twice"), F.count(F.when(F.col("n") > 2, 1)).alias("more"), F.round(F.lit(100.0) * F.count(F.when(F.col("n") >= 2, 1)) / F.count(F.lit(1)), 4).alias("percent"))


@query("f2_normalize_url", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ipfs:Qm' || md5(url) || '/1' WHEN 1 THEN rtrim(lower(trim(url)), '/') WHEN 2 THEN NULL ELSE 'ar:' || md5(url) END AS uri FROM pages")
def normalize_url(spark: SparkSession, folder: str) -> DataFrame:
    m = F.md5(F.col("url").cast("binary"))
    raw = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" ipfs://IPFS/Qm"), m, F.lit("/1/?x=1"))).when(F.col("page_id") % 4 == 1, F.concat("url", F.lit("/"))).when(F.col("page_id") % 4 == 2, F.lit("data:image/png;base64,AA")).otherwise(F.concat(F.lit("AR://"), m, F.lit("#top")))
    return table(spark, folder, "pages").select("page_id", T.normalize_url(raw).alias("uri"))


@query("f4_jaro_winkler", "SELECT p_partkey, n_nationkey, round(jaro_winkler_similarity(p_name, lower(n_name)), 6) AS score FROM part, nation")
def jaro_winkler(spark: SparkSession, folder: str) -> DataFrame:
    """Every part's name with every nation's; the nations are a table of 25 rows."""
    few = table(spark, folder, "nation").select("n_nationkey", F.lower("n_name").alias("n_name"))
    pairs = table(spark, folder, "part").select("p_partkey", "p_name").crossJoin(F.broadcast(few))
    return pairs.select("p_partkey", "n_nationkey", F.round(jaro_winkler_udf("p_name", "n_name"), 6).alias("score"))


