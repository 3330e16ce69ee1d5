"""Duplicates by token URI and, supplementary, by image URI, counted by scope.

Scopes: ``intra`` (another contract of the chain has the URI), ``cross`` (another chain has it), ``matrix`` (a named other chain
has it). No pairs are formed: a URI's contracts are counted by chain, and the counts (at most one entry a chain) are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHAINS = ("base", "ethereum", "polygon", "solana")


def postings(nft: DataFrame, uri: str) -> DataFrame:
    """uri, chain, contract, nfts: rows of each non-empty URI by contract."""
    return nft.where(F.coalesce(F.col(uri), F.lit("")) != "").groupBy(F.col(uri).alias("uri"), "chain", "contract").agg(F.count(F.lit(1)).alias("nfts"))


def presence(rows: DataFrame) -> DataFrame:
    """uri, seen: a map from chain to the number of its contracts that have the URI."""
    return rows.groupBy("uri", "chain").agg(F.count(F.lit(1)).alias("k")).groupBy("uri").agg(F.map_from_entries(F.collect_list(F.struct("chain", "k"))).alias("seen"))


def other_chains(seen: str = "seen", chain: str = "chain") -> Column:
    return F.filter(F.map_keys(F.col(seen)), lambda c: c != F.col(chain))


def scope_rows(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """uri, chain, contract, nfts, scope, peer: one row for each scope in which the posting is a duplicate."""
    both = rows.join(seen, "uri").withColumn("peers", other_chains())
    intra = F.when(F.element_at("seen", F.col("chain")) >= 2, F.array(F.struct(F.lit("intra").alias("scope"), F.col("chain").alias("peer")))).otherwise(F.array())
    cross = F.when(F.size("peers") > 0, F.array(F.struct(F.lit("cross").alias("scope"), F.lit("").alias("peer")))).otherwise(F.array())
    matrix = F.transform("peers", lambda p: F.struct(F.lit("matrix").alias("scope"), p.alias("peer")))
    return both.select("uri", "chain", "contract", "nfts", F.explode(F.concat(intra, cross, matrix)).alias("s")).select("uri", "chain", "contract", "nfts", "s.scope", "s.peer")


def count_scopes(found: DataFrame) -> DataFrame:
    """scope, chain, peer, contracts (distinct), nfts (rows)."""
    return found.groupBy("scope", "chain", "peer").agg(F.countDistinct("contract").alias("contracts"), F.sum("nfts").alias("nfts"))


def token_uri_scopes(nft: DataFrame) -> DataFrame:
    rows = postings(nft, "token_uri")
    return count_scopes(scope_rows(rows, presence(rows)))


def image_uri_scopes(nft: DataFrame, chains: tuple[str, ...] = CHAINS) -> DataFrame:
    """Image duplicates among NFTs that are no token duplicates in that scope; in the matrix both sides must remain."""
    rows = postings(nft, "token_uri")
    seen = presence(rows).withColumnRenamed("uri", "token_uri")
    own = nft.where(F.coalesce(F.col("image_uri"), F.lit("")) != "").join(seen, "token_uri", "left")
    own = own.withColumn("peers", F.coalesce(other_chains(), F.array().cast("array<string>"))).withColumn("hit", F.coalesce(F.element_at("seen", F.col("chain")) >= 2, F.lit(False)))

    def left(frame: DataFrame) -> DataFrame:
        return postings(frame, "image_uri")

    intra_rows = left(own.where(~F.col("hit")))
    cross_rows = left(own.where(F.size("peers") == 0))
    intra = scope_rows(intra_rows, presence(intra_rows)).where("scope = 'intra'")
    cross = scope_rows(cross_rows, presence(cross_rows)).where("scope = 'cross'")
    against = own.withColumn("peer", F.explode(F.array_except(F.array(*map(F.lit, chains)), F.concat(F.array("chain"), "peers"))))
    sides = against.groupBy(F.col("image_uri").alias("uri"), "chain", "peer", "contract").agg(F.count(F.lit(1)).alias("nfts"))
    back = sides.select("uri", F.col("peer").alias("chain"), F.col("chain").alias("peer")).distinct()
    matrix = sides.join(back, ["uri", "chain", "peer"]).select("uri", "chain", "contract", "nfts", F.lit("matrix").alias("scope"), "peer")
    return count_scopes(intra.unionByName(cross).unionByName(matrix))


def chain_totals(nft: DataFrame) -> DataFrame:
    return nft.groupBy("chain").agg(F.countDistinct("contract").alias("contracts"), F.count(F.lit(1)).alias("nfts"))


def with_ratios(scopes: DataFrame, totals: DataFrame, dimension: Column, name: str = "dimension") -> DataFrame:
    """Scope counts with their denominators; a ratio over 0 is null."""
    t = totals.select("chain", F.col("contracts").alias("total_contracts"), F.col("nfts").alias("total_nfts"))
    return scopes.join(t, "chain").select(dimension.alias(name), "scope", "chain", "peer", "contracts", "nfts", "total_contracts", "total_nfts", F.round(F.try_divide("contracts", "total_contracts"), 6).alias("contract_ratio"), F.round(F.try_divide("nfts", "total_nfts"), 6).alias("nft_ratio"))


def seed_uri_hits(nft: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed_chain, seed_contract, kind, chain, contract, scope, nfts: how many NFTs ``seed_uri_rows`` finds."""
    return seed_uri_rows(nft, seeds).groupBy("seed_chain", "seed_contract", "kind", "chain", "contract", "scope").agg(F.count(F.lit(1)).alias("nfts"))


def seed_uri_rows(nft: DataFrame, seeds: DataFrame) -> DataFrame:
    """kind, seed_chain, seed_contract, chain, contract, row_order, scope: NFTs that share a token or image URI with a seed's NFTs.

    Scopes: ``intra`` (another contract of the seed's chain) and ``cross`` (another chain). An image counts in a scope only if one
    of the seed's NFTs with it has no token hit there, and a candidate's NFT that is a token hit there is left out.
    """
    seed = seeds.select(F.col("chain"), F.col("contract")).distinct()
    key = ["seed_chain", "seed_contract"]
    own = nft.join(seed, ["chain", "contract"], "left_semi").select(F.col("chain").alias("seed_chain"), F.col("contract").alias("seed_contract"), F.col("row_order").alias("seed_row"), "token_uri", "image_uri")
    scope = F.when(F.col("chain") == F.col("seed_chain"), F.lit("intra")).otherwise(F.lit("cross"))
    other = (F.col("chain") != F.col("seed_chain")) | (F.col("contract") != F.col("seed_contract"))

    def candidates(wanted: DataFrame, uri: str) -> DataFrame:
        rows = nft.where(F.coalesce(F.col(uri), F.lit("")) != "").select(uri, "chain", "contract", "row_order")
        return rows.join(wanted, uri).where(other).withColumn("scope", scope)

    token = candidates(own.select(*key, "token_uri").distinct(), "token_uri").select(*key, "token_uri", "chain", "contract", "row_order", "scope")
    hit = own.join(token.select(*key, "token_uri", "scope").distinct(), [*key, "token_uri"]).select(*key, "seed_row", "scope")
    unhit = own.withColumn("scope", F.explode(F.array(F.lit("intra"), F.lit("cross")))).join(hit, [*key, "seed_row", "scope"], "left_anti")
    images = unhit.select(*key, "image_uri", F.col("scope").alias("wanted")).distinct()
    image = candidates(images, "image_uri").where("scope = wanted").join(token.select(*key, "row_order", "scope"), [*key, "row_order", "scope"], "left_anti")
    columns = [*key, "chain", "contract", "row_order", "scope"]
    return token.select(F.lit("token_uri").alias("kind"), *columns).unionByName(image.select(F.lit("image_uri").alias("kind"), *columns)).distinct()


def hit_scopes(intra: Column, cross: Column, peers: Column) -> Column:
    """The (scope, peer) in which an NFT is a duplicate, as an array: at most one entry a chain besides the first two."""

    def one(held: Column, scope: str, peer: Column) -> Column:
        found = F.array(F.struct(F.lit(scope).alias("scope"), peer.alias("peer")))
        return F.when(held, found).otherwise(F.filter(found, lambda _: F.lit(False)))

    return F.concat(one(intra, "intra", F.col("chain")), one(cross, "cross", F.lit("")), F.transform(peers, lambda p: F.struct(F.lit("matrix").alias("scope"), p.alias("peer"))))


def with_uri(rows: DataFrame, found: DataFrame, uri: str) -> DataFrame:
    """``rows`` with what is ``found`` (uri and others) of their URI, or nulls; rows that have none are dealt out evenly."""
    without = F.coalesce(F.col(uri), F.lit("")) == ""
    own = rows.withColumn("uri", F.coalesce(F.col(uri), F.lit(""))).withColumn("spread", F.when(without, F.xxhash64("row_order")).otherwise(F.lit(0).cast("long"))).drop(uri)
    return own.join(found.withColumn("spread", F.lit(0).cast("long")), ["uri", "spread"], "left").drop("uri", "spread")


def nft_hits(nft: DataFrame, chains: tuple[str, ...] = CHAINS) -> DataFrame:
    """The rows with ``token_hits`` and ``image_hits`` for their URIs: where (scope, peer) ``token_uri_scopes`` and ``image_uri_scopes``
    count them.

    Rows are dealt out once for each URI, and not once for each scope.
    """
    own = with_uri(nft, presence(postings(nft, "token_uri")), "token_uri")
    own = own.withColumn("peers", F.coalesce(other_chains(), F.array().cast("array<string>"))).withColumn("intra", F.coalesce(F.element_at("seen", F.col("chain")) >= 2, F.lit(False))).drop("seen")
    free = F.size("peers") == 0
    against = F.array_except(F.array(*map(F.lit, chains)), F.concat(F.array("chain"), F.col("peers")))
    # what of an image is left in a scope: contracts of a chain, chains, or the other side of a pair of chains
    open_ = own.where(F.coalesce(F.col("image_uri"), F.lit("")) != "").withColumn("contract", F.when(~F.col("intra"), F.col("contract")))
    sides = open_.groupBy(F.col("image_uri").alias("uri"), "chain").agg((F.min("contract") < F.max("contract")).alias("several"), F.bool_or(free).alias("free"), F.array_compact(F.array(*(F.when(F.bool_or(F.array_contains(against, c)), F.lit(c)) for c in chains))).alias("against"))
    sides = sides.groupBy("uri").agg(F.collect_list(F.struct("chain", "several", "free", "against")).alias("sides"))

    def among(held) -> Column:
        return F.coalesce(F.exists("sides", held), F.lit(False))

    own = with_uri(own, sides, "image_uri")
    token = hit_scopes(F.col("intra"), ~free, F.col("peers"))
    back = F.filter(against, lambda p: among(lambda x: (x["chain"] == p) & F.array_contains(x["against"], F.col("chain"))))
    image = hit_scopes(~F.col("intra") & among(lambda x: (x["chain"] == F.col("chain")) & x["several"]), free & among(lambda x: (x["chain"] != F.col("chain")) & x["free"]), back)
    return own.withColumn("token_hits", token).withColumn("image_hits", image).drop("peers", "intra", "sides")
