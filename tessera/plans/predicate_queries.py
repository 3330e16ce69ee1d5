"""Queries of predicates and normal forms over varied strings.

The strings are made by projections that both engines read alike (``samples``); the rules are written twice, as column
expressions of the library and as SQL of the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import economics, evidence, snapshot
from tessera.plans import report_queries as RQ
from tessera.plans.registry import query
from tessera.sources.fixtures import MOVES_SQL, moves, table

M = "WITH RECURSIVE " + MOVES_SQL
#: White space around a value, by number.
BEFORE = "CASE k % 6 WHEN 0 THEN ' ' WHEN 1 THEN chr(9) WHEN 2 THEN chr(10) || '  ' WHEN 3 THEN chr(13) || chr(10) ELSE '' END"
AFTER = "CASE k % 5 WHEN 0 THEN '   ' WHEN 1 THEN chr(9) || chr(10) WHEN 2 THEN chr(12) ELSE '' END"
TRIM_SQL = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def samples(spark: SparkSession, folder: str, name: str, **columns: str) -> DataFrame:
    """k (from ``part`` or ``customer``) and columns of SQL that both engines read alike."""
    own = table(spark, folder, name).selectExpr(f"{'p_partkey' if name == 'part' else 'c_custkey'} AS k", "*")
    return own.selectExpr("k", *(f"{sql} AS {c}" for c, sql in columns.items()))


def sample_sql(name: str, **columns: str) -> str:
    return f"s AS (SELECT k, {', '.join(f'{sql} AS {c}' for c, sql in columns.items())} FROM (SELECT {'p_partkey' if name == 'part' else 'c_custkey'} AS k, * FROM {name}))"


def case(cases: list[str], of: str = "k") -> str:
    return f"CASE {of} % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


def strings(values: tuple[str, ...]) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


CHAINS = f"{BEFORE} || {case(['upper(c_mktsegment)', 'c_mktsegment', 'lower(c_mktsegment)', 'NULL', chr(39) + 'Base' + chr(39)])} || {AFTER}"


@query("p1_row_normalise", f"WITH {sample_sql('customer', raw=CHAINS)} SELECT k, lower({TRIM_SQL.format('coalesce(raw, chr(32))')}) AS chain FROM s")
def row_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder, "customer", raw=CHAINS).select("k", T.chain_key(F.col("raw")).alias("chain"))


WORDS = case([*strings((*T.NULL_LIKE_NAMES, "7", "77", "", "x", "none of it", "0", "nana", "n a", "..")), "NULL"], "(k * 7)")
RAW_NAMES = f"{BEFORE} || {case([f'upper({WORDS})', WORDS, f'initcap({WORDS})'.replace('initcap', 'lower')], '(k % 3)')} || {AFTER}"


@query("p2_usable_names", f"WITH {sample_sql('part', raw=RAW_NAMES)}, t AS (SELECT k, lower({TRIM_SQL.format('coalesce(raw, chr(32))')}) AS name FROM s) SELECT k, name <> '' AND name NOT IN ({', '.join(strings(T.NULL_LIKE_NAMES))}) AND NOT regexp_full_match(name, '[0-9]') AS usable FROM t")
def usable_names(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder, "part", raw=RAW_NAMES).select("k", T.usable_name(F.col("raw")).alias("usable"))


DOCUMENTS = case([
    """'{"size": ' || CAST(p_size AS STRING) || ', "name": "' || p_brand || '"}'""", "'{\"a\": 1, \"a\": 2}'", "'[1, 2'", "'{}'", "' {  } '", "'\"text\"'", "'[]'", "chr(10) || '[{\"x\": null}] '", "'{\"k\":\"' || repeat('x', 65528) || '\"}'",
    "'{\"k\":\"' || repeat('x', 65529) || '\"}'", "'{\"k\":\"' || repeat('é', 32764) || '\"}'", "'{\"k\":\"' || repeat('é', 32765) || '\"}'", "''", "NULL", "'{\"a\": {\"b\": [1, 2.50, 1e3, true]}}'", "'{\"a\": tru}'", "'{\"t\": \"\\\\u00e9 \\\\n\"}'", "'7'",
])


@query("p3_valid_metadata", f"WITH {sample_sql('part', raw=DOCUMENTS)}, t AS (SELECT k, {TRIM_SQL.format('coalesce(raw, chr(32))')} AS j FROM s) SELECT k, coalesce(json_valid(j) AND strlen(j) <= 65536 AND j[1] IN ('{{', '[') AND NOT regexp_full_match(j, '\\{{\\s*\\}}') AND (j[1] = '[' OR CASE WHEN json_valid(j) THEN len(json_keys(j)) = len(list_distinct(json_keys(j))) END), false) AS valid FROM t")
def valid_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder, "part", raw=DOCUMENTS).select("k", snapshot.valid_metadata(F.col("raw")).alias("valid"))


ADDRESS = f"{BEFORE} || {case([*strings(tuple(a for _, a in T.PLATFORM_CONTRACTS)), *[f'upper({x})' for x in strings(tuple(a for _, a in T.PLATFORM_CONTRACTS[-3:]))], chr(39) + '0x' + chr(39) + ' || md5(CAST(k AS STRING))', 'NULL'], '(k * 5)')} || {AFTER}"
CHAIN = case(["'Ethereum '", "'base'", "' BASE'", "'polygon'", "'shape'", "'solana'", "'sepolia'"])
PLATFORMS_SQL = "(VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in T.PLATFORM_CONTRACTS) + ") p(chain, address)"
IS_PLATFORM = f"EXISTS (SELECT 1 FROM {PLATFORMS_SQL} WHERE p.chain = lower(trim(c)) AND p.address = lower({TRIM_SQL.format('coalesce(a, chr(32))')}))"


@query("p7_platform_contracts", f"WITH {sample_sql('customer', c=CHAIN, a=ADDRESS)} SELECT k, EXISTS (SELECT 1 FROM {PLATFORMS_SQL} WHERE p.chain = lower(c) AND p.address = lower(a)) AS platform FROM s")
def platform_contracts(spark: SparkSession, folder: str) -> DataFrame:
    # letters of both cases; values are compared as they are, so white space must have been taken off before
    return samples(spark, folder, "customer", c=CHAIN, a=ADDRESS).select("k", F.coalesce(T.platform_contract(F.col("c"), F.col("a")), F.lit(False)).alias("platform"))


@query("p11_without_platforms", f"WITH {sample_sql('customer', c=CHAIN, a=ADDRESS)} SELECT lower(trim(c)) AS chain, count(*) AS kept FROM s WHERE NOT {IS_PLATFORM} GROUP BY 1")
def without_platforms(spark: SparkSession, folder: str) -> DataFrame:
    platforms = spark.createDataFrame(list(T.PLATFORM_CONTRACTS), "chain string, address string")
    own = samples(spark, folder, "customer", c=CHAIN, a=ADDRESS).select(T.chain_key(F.col("c")).alias("chain"), T.address_key(F.col("c"), F.col("a")).alias("address"))
    # a fixed list of eleven contracts
    return own.join(F.broadcast(platforms), ["chain", "address"], "left_anti").groupBy("chain").agg(F.count(F.lit(1)).alias("kept"))


ZERO = "0x" + "0" * 40
ZEROES = f"{BEFORE} || {case([chr(39) + ZERO + chr(39), 'upper(' + chr(39) + ZERO + chr(39) + ')', chr(39) * 2, chr(39) + '0x0' + chr(39), chr(39) + '0xAb' + chr(39) + ' || CAST(k AS STRING)', 'NULL'], '(k * 11)')}"


@query("p5_zero_address", f"WITH {sample_sql('customer', c=CHAIN, a=ZEROES)}, t AS (SELECT k, lower(trim(c)) AS c, {TRIM_SQL.format('coalesce(a, chr(32))')} AS a FROM s) SELECT k, a <> '' AND (c = 'solana' OR lower(a) <> '{ZERO}') AS usable FROM t")
def zero_address(spark: SparkSession, folder: str) -> DataFrame:
    own = samples(spark, folder, "customer", c=CHAIN, a=ZEROES)
    key, chain = T.address_key(F.col("c"), F.col("a")), T.chain_key(F.col("c"))
    return own.select("k", ((key != "") & ((chain == "solana") | (key != ZERO))).alias("usable"))


SYMBOL = f"{case([' chr(32)', 'chr(32) || chr(32)', chr(39) * 2])} || {case([f'{f}({x})' for i, x in enumerate(strings((*economics.STABLECOINS, *(s for v in economics.NATIVE.values() for s in v), 'DOGE', 'ETHX', 'USD'))) for f in ('upper' if i % 2 else 'lower',)], '(k * 3)')}"
COIN_CHAIN = case([*strings(tuple(economics.NATIVE)), "' Polygon '", "'optimism'"])
NATIVE_SQL = " OR ".join(f"(lower(trim(c)) = '{c}' AND upper(trim(x)) IN ({', '.join(strings(v))}))" for c, v in economics.NATIVE.items())


@query("p12_payment_tokens", f"WITH {sample_sql('part', c=COIN_CHAIN, x=SYMBOL)} SELECT k, {NATIVE_SQL} AS native, upper(trim(x)) IN ({', '.join(strings(economics.STABLECOINS))}) AS stable FROM s")
def payment_tokens(spark: SparkSession, folder: str) -> DataFrame:
    own = samples(spark, folder, "part", c=COIN_CHAIN, x=SYMBOL)
    return own.select("k", economics.chain_native(F.col("c"), F.col("x")).alias("native"), economics.symbol_key(F.col("x")).isin(*economics.STABLECOINS).alias("stable"))


@query("p10_evidence_status", M + RQ.EVIDENCE_SQL + ", l AS (SELECT 'transfers' AS family, chain, transfers AS state FROM ev UNION ALL SELECT 'sales', chain, sales_state FROM ev) SELECT family, chain, count(*) FILTER (state IN ('complete', 'truncated')) AS usable, count(*) AS contracts FROM l GROUP BY ALL")
def evidence_status(spark: SparkSession, folder: str) -> DataFrame:
    own = RQ.evidence_states(moves(spark, folder))
    long = own.select("chain", F.explode(F.array(F.struct(F.lit("transfers").alias("family"), F.col("transfers").alias("state")), F.struct(F.lit("sales").alias("family"), F.col("sales_state").alias("state")))).alias("x")).select("chain", "x.*")
    return long.groupBy("family", "chain").agg(F.count(F.when(evidence.usable(F.col("state")), 1)).alias("usable"), F.count(F.lit(1)).alias("contracts"))


@query("e13_completeness", M + RQ.EVIDENCE_SQL + " SELECT chain, contract, transfers IN ('complete', 'empty') AND sales_state IN ('complete', 'empty') AND (chain <> 'solana' OR length(contract) = 2) AS complete FROM ev")
def completeness(spark: SparkSession, folder: str) -> DataFrame:
    own = RQ.evidence_states(moves(spark, folder)).drop("complete").withColumnRenamed("sales_state", "sales").withColumn("assets", F.when(F.length("contract") == 2, "empty").otherwise("failed"))
    return evidence.complete(own, ["transfers", "sales"]).select("chain", "contract", "complete")


TOKENS = case(["CAST(k AS STRING)", "'000' || CAST(k AS STRING)", "'0'", "'0000'", "CAST(k AS STRING) || 'x'", "'-' || CAST(k AS STRING)", "''", "repeat('9', 80) || CAST(k AS STRING)", "'00x1'", "' 1'"])


@query("f7_token_id", f"WITH {sample_sql('part', raw=TOKENS)} SELECT k, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN 0 ELSE 1 END AS other, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN coalesce(nullif(ltrim(raw, '0'), ''), '0') ELSE raw END AS token FROM s")
def token_id(spark: SparkSession, folder: str) -> DataFrame:
    key = T.token_key(F.col("raw"))
    return samples(spark, folder, "part", raw=TOKENS).select("k", key["other"].alias("other"), key["text"].alias("token"))


HEX = "substr(md5(CAST(k AS STRING)) || md5(CAST(k + 1 AS STRING)), 1, 40)"
ACCOUNTS = f"{BEFORE} || {case([chr(39) + '0x' + chr(39) + ' || ' + HEX, chr(39) + '0X' + chr(39) + ' || upper(' + HEX + ')', HEX, chr(39) + '0x' + chr(39) + ' || substr(' + HEX + ', 2)', 'translate(' + HEX + ', ' + chr(39) + '0' + chr(39) + ', ' + chr(39) + 'Z' + chr(39) + ')', chr(39) + '0x' + chr(39) + ' || translate(' + HEX + ', ' + chr(39) + 'a' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')', 'repeat(' + chr(39) + 'l' + chr(39) + ', 36)', 'repeat(' + chr(39) + 'K' + chr(39) + ', 31 + k % 16)', chr(39) * 2])} || {AFTER}"


@query("f8_addresses", f"WITH {sample_sql('customer', raw=ACCOUNTS)}, t AS (SELECT k, {TRIM_SQL.format('raw')} AS a FROM s) SELECT k, regexp_full_match(lower(a), '0x[0-9a-f]{{40}}') AS evm, regexp_full_match(a, '[1-9A-HJ-NP-Za-km-z]{{32,44}}') AS base58 FROM t")
def addresses(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder, "customer", raw=ACCOUNTS).select("k", T.valid_evm_address(F.col("raw")).alias("evm"), T.valid_base58_address(F.col("raw")).alias("base58"))


TITLES = f"{BEFORE} || {case(['p_name', 'upper(p_name)', chr(39) + 'Cool   Cat' + chr(39), chr(39) + 'Punk' + chr(39), chr(39) + 'a' + chr(39)], '(k * 3)')} || {case([chr(39) + x + chr(39) for x in (' #12', '', ' - 7', ' (3)', ' [ 44 ]', ' No. 5', ': 9', '/12', ' 00123', ' #0xfA', ' (4) #7', ' 7 8', ' nr 3', ' No.', ' #', '-x')])} || {AFTER}"
STEPS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN {TRIM_SQL.format(f'regexp_replace(name, {chr(39)}{p}{chr(39)}, {chr(39)}{chr(39)})')}" for p in T.TRAILING_NUMBERS) + " ELSE name END"


@query("f1_normalize_name", f"WITH RECURSIVE {sample_sql('part', raw=TITLES)}, r AS (SELECT k, 0 AS n, {TRIM_SQL.format('raw')} AS name FROM s UNION ALL SELECT k, n + 1, {STEPS_SQL} FROM r WHERE n < {T.MOST_SUFFIXES} AND {STEPS_SQL} <> name) SELECT k, lower(trim(regexp_replace(arg_max(name, n), '\\s+', ' ', 'g'))) AS name FROM r GROUP BY k")
def normalize_name(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder, "part", raw=TITLES).select("k", T.normalize_name(F.col("raw")).alias("name"))


NESTED = case([
    """'{"Description": " ' || p_name || ' ", "attributes": [{"trait_type": "' || p_brand || '", "value": 1}, {"value": "' || p_type || '", "other": "no"}]}'""",
    """'{"raw": {"metadata": {"image": "i' || CAST(p_size AS STRING) || '", "name": "no", "attributes": [["deep ' || p_name || '"], []]}}, "hidden": {"image": "no"}}'""",
    """'[{"value": "a"}, {"value": ""}, {"VALUE": "' || p_brand || '"}, "top"]'""", """'{"image": null, "value": true, "external_url": "  "}'""", "'{}'", """'"alone"'""",
])


@query("f16_flat_texts", f"WITH {sample_sql('part', raw=NESTED)}, t AS (SELECT k, trim(atom ->> '$') AS x, [lower(y) FOR y IN regexp_extract_all(fullkey, '\\.([A-Za-z_]+)', 1)] AS keys FROM s, json_tree(raw) WHERE type = 'VARCHAR'), u AS (SELECT k, list_sort(list(x)) AS texts FROM t WHERE x <> '' AND len(list_filter(keys, lambda y: y NOT IN ({', '.join(strings(tuple(sorted(evidence.FLAT_KEYS))))}))) = 0 GROUP BY k) SELECT s.k, array_to_string(coalesce(texts, []), '|') AS texts FROM s LEFT JOIN u ON u.k = s.k")
def flat_texts(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder, "part", raw=NESTED).select("k", F.array_join(F.sort_array(evidence.flat_texts_udf("raw")), "|").alias("texts"))
