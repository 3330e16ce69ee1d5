"""Evidence tables made from the driver's tables, by the same plain projections on both engines.

The driver's tables hold no NFTs, so the operators run on deterministic views: ``nft`` (a snapshot, from documents; names in ASCII, as the
oracle's Jaro-Winkler works on bytes) and
``moves`` (sales and transfers, from events). ``NFT_SQL`` and ``MOVES_SQL`` are the same views for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NFT_SQL = r"""nft AS (
  SELECT (['base', 'ethereum', 'polygon', 'solana'])[CAST(doc_id % 4 AS INT) + 1] AS chain,
         source || '-' || CAST((doc_id // 100) % 5 AS VARCHAR) AS contract, CAST(doc_id // 20 AS VARCHAR) AS token_id,
         regexp_replace(lower(trim(substr(text, 1, 24))), '[^\x00-\x7F]', '_', 'g') AS name_norm, md5(text) AS token_uri, md5(substr(text, 1, 80)) AS image_uri,
         text AS body, doc_id AS row_order
  FROM documents)"""

MOVES_SQL = """raw_moves AS (
  SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id AS src, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS token,
         lead(user_id) OVER (PARTITION BY CAST(json_extract_string(props, '$.k') AS BIGINT) ORDER BY ts, event_id) AS dst
  FROM events),
moves AS (
  SELECT event_id, (['base', 'ethereum', 'polygon', 'solana'])[CAST(token % 4 AS INT) + 1] AS chain,
         'c' || CAST(token % 20 AS VARCHAR) AS contract, token, src, dst, ts, event_type = 'purchase' AS is_sale,
         CASE WHEN event_type = 'purchase' THEN value END AS usd
  FROM raw_moves WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
sales AS (SELECT * FROM moves WHERE is_sale),
holders AS (
  SELECT chain, contract, token, dst AS owner FROM (
    SELECT *, row_number() OVER (PARTITION BY chain, contract, token ORDER BY ts DESC, event_id DESC) AS rn FROM moves) WHERE rn = 1),
roles AS (
  SELECT a.chain, a.contract, a.address, CASE WHEN v.address IS NULL THEN 'operator' ELSE 'victim' END AS role
  FROM (SELECT chain, contract, src AS address FROM moves UNION SELECT chain, contract, dst FROM moves) a
  LEFT JOIN (SELECT DISTINCT s.chain, s.contract, s.dst AS address FROM sales s
             JOIN holders h ON h.chain = s.chain AND h.contract = s.contract AND h.token = s.token AND h.owner = s.dst
             WHERE s.usd > 0) v USING (chain, contract, address))"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nft(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot: chain, contract, token_id, name_norm, token_uri, image_uri, body, row_order."""
    return table(spark, folder, "documents").selectExpr(
        "element_at(array('base', 'ethereum', 'polygon', 'solana'), cast(doc_id % 4 as int) + 1) AS chain",
        "concat(source, '-', cast((doc_id div 100) % 5 as string)) AS contract",
        "cast(doc_id div 20 as string) AS token_id",
        "regexp_replace(lower(trim(substr(text, 1, 24))), '[^\\\\x00-\\\\x7F]', '_') AS name_norm",
        "md5(cast(text as binary)) AS token_uri",
        "md5(cast(substr(text, 1, 80) as binary)) AS image_uri",
        "text AS body",
        "doc_id AS row_order",
    )


def moves(spark: SparkSession, folder: str) -> DataFrame:
    """Sales and transfers: event_id, chain, contract, token, src, dst, ts (unix seconds), is_sale, usd.

    The next user of a token receives it; the window is over one token's events.
    """
    return (
        table(spark, folder, "events")
        .selectExpr("event_id", "ts AS at", "user_id AS src", "event_type", "value", "cast(get_json_object(props, '$.k') as bigint) AS token")
        .selectExpr("*", "lead(src) OVER (PARTITION BY token ORDER BY at, event_id) AS dst", "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(at as timestamp_ntz)) AS ts")
        .where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .selectExpr(
            "event_id",
            "element_at(array('base', 'ethereum', 'polygon', 'solana'), cast(token % 4 as int) + 1) AS chain",
            "concat('c', cast(token % 20 as string)) AS contract",
            "token",
            "src",
            "dst",
            "ts",
            "event_type = 'purchase' AS is_sale",
            "CASE WHEN event_type = 'purchase' THEN value END AS usd",
        )
    )
