"""Snapshots of NFTs: validation, source order, first-wins and best-row rules, seeds, samples, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import chain_key, token_key, trimmed

#: Metadata may be so many bytes.
MOST_METADATA = 65_536


def normalised(nft: DataFrame) -> DataFrame:
    """Chains in lower case, strings trimmed, null as empty; rows without a key part go."""
    out = nft.withColumn("chain", chain_key(F.col("chain")))
    for c in ("contract", "token_id", "name_norm", "token_uri", "image_uri"):
        out = out.withColumn(c, trimmed(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    return out.where("chain != '' AND contract != '' AND token_id != ''")


def allowed(nft: DataFrame, chains: list[str]) -> DataFrame:
    """Rows of the listed chains (as stored, so that the filter reaches the scan)."""
    return nft.where(F.col("chain").isin(*sorted({c.strip().lower() for c in chains})))


def contracts_that_matter(nft: DataFrame) -> DataFrame:
    """chain, contract: contracts that share a token URI with another one. Reads no metadata."""
    own = nft.select("chain", "contract", "token_uri").distinct()
    often = own.groupBy("token_uri").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token_uri")
    return own.join(often, "token_uri", "left_semi").select("chain", "contract").distinct()


def second_pass(nft: DataFrame, contracts: DataFrame) -> DataFrame:
    return nft.join(contracts, ["chain", "contract"], "left_semi")


def best_rows(nft: DataFrame) -> DataFrame:
    """One row for each key: the one with most filled fields, then the longest metadata, then in order of the fields."""
    filled = sum(F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in ("name_norm", "token_uri", "image_uri"))
    w = Window.partitionBy("chain", "contract", "token_id").orderBy(filled.desc(), F.length("body").desc(), "token_uri", "row_order")
    return nft.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def first_wins(rows: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """For each key and column on its own, the first value that is not empty."""
    return rows.groupBy(*keys).agg(*(F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order))).alias(c) for c in columns))


def anchors(nft: DataFrame, k: int | None) -> DataFrame:
    """The first k rows of each contract by token id (all if k is None)."""
    if k is None:
        return nft
    key = token_key(F.col("token_id"))
    w = Window.partitionBy("chain", "contract").orderBy(key["other"], key["digits"], key["text"], key["raw"], "row_order")
    return nft.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def population(nft: DataFrame, cap: int = 50_000) -> DataFrame:
    """At most ``cap`` rows a contract, with a flag where it had more: a bounded population is the feature."""
    w = Window.partitionBy("chain", "contract").orderBy("row_order")
    size = nft.groupBy("chain", "contract").agg((F.count(F.lit(1)) > cap).alias("capped"))
    return nft.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn").join(size, ["chain", "contract"])


def seed_list(seeds: DataFrame) -> DataFrame:
    """chain, contract, rank: distinct seeds in order. Seeds are a short list given by hand."""
    own = seeds.select(chain_key(F.col("chain")).alias("chain"), trimmed(F.col("contract")).alias("contract")).where("chain != '' AND contract != ''").distinct()
    return own.withColumn("rank", F.row_number().over(Window.orderBy("chain", "contract")))


def valid_metadata(c: Column) -> Column:
    """Whether a string is JSON of at most 64 KiB, an object or array, not an empty object, without repeated keys."""
    own = trimmed(c)
    return F.coalesce((own != "") & (F.octet_length(own) <= MOST_METADATA) & own.rlike(r"^[{\[]") & ~own.rlike(r"^\{\s*\}$") & F.try_parse_json(own).isNotNull(), F.lit(False))


def sample(rows: DataFrame, pools: list[str], ids: list[str], n: int, seed: int) -> DataFrame:
    """n rows of each pool, by the smallest seeded hash (MD5 of seed and ids)."""
    w = Window.partitionBy(*pools).orderBy(F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in ids)).cast("binary")), *ids)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def threshold_clusters(pairs: DataFrame) -> DataFrame:
    """name, cluster (its smallest name): connected components of (left, right) pairs, by rounds of smallest labels."""
    from tessera.runtime import materialise

    both = materialise(pairs.select("left", "right").unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct(), "cluster-pairs")
    now = materialise(both.groupBy(F.col("left").alias("name")).agg(F.min("right").alias("m")).select("name", F.least("name", "m").alias("cluster")), "clusters")
    while True:
        near = both.join(now.withColumnRenamed("name", "right"), "right").select(F.col("left").alias("name"), "cluster")
        hop = now.join(now.select(F.col("name").alias("cluster"), F.col("cluster").alias("next")), "cluster").select("name", F.col("next").alias("cluster"))
        after = materialise(now.unionByName(near).unionByName(hop).groupBy("name").agg(F.min("cluster").alias("cluster")), "clusters")
        if not after.join(now, ["name", "cluster"], "left_anti").limit(1).count():
            return after
        now = after
