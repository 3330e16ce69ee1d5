"""Evidence quality, mint payments, costs, losses, metrics and cached intermediate tables."""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.operators.graphs import KEY
from tessera.runtime import scratch_dir

USABLE = ("complete", "truncated")
DONE = ("complete", "empty")
# Channels of money and the stage whose cost they are.
STAGE_OF = {"deployment": "setup", "contract_deploy": "setup", "funding": "setup", "mint_payment": "lure", "sale_payment": "lure", "lure_payment": "lure", "withdrawal": "exit", "cashout_hop": "exit", "exit_payment": "exit"}
# Metadata keys whose values belong to a prefilter document.
VALUE_KEYS = ("description", "bio", "story", "lore", "summary", "about", "seller_fee_basis_points", "fee_recipient", "royalty", "royalties", "creator", "creators", "compiler", "license", "collection", "marketplace", "contract", "chain")


def usable(status: Column) -> Column:
    return status.isin(*USABLE)


def complete(rows: DataFrame, families: list[str]) -> DataFrame:
    """rows with ``complete``: every family is complete or empty; Solana also needs assets and histories where they are columns."""
    ok = F.lit(True)
    for f in families:
        ok = ok & F.col(f).isin(*DONE)
    for f in ("assets", "histories"):
        if f in rows.columns:
            ok = ok & ((F.col("chain") != "solana") | F.col(f).isin(*DONE))
    return rows.withColumn("complete", F.coalesce(ok, F.lit(False)))


def attach_mint_payments(mints: DataFrame, flows: DataFrame) -> DataFrame:
    """mints (chain, contract, tx, dst, ...) with ``paid`` and ``receiver``: the largest payment of the receiver in that transaction."""
    pay = flows.groupBy("chain", "tx", F.col("src").alias("dst")).agg(F.max(F.struct("usd", F.col("dst").alias("receiver"))).alias("p"))
    return mints.join(pay, ["chain", "tx", "dst"], "left").withColumn("paid", F.col("p.usd")).withColumn("receiver", F.col("p.receiver")).drop("p")


def controlled_payments(mints: DataFrame, controllers: DataFrame) -> DataFrame:
    """Payments whose receiver is no controller of the contract are taken back."""
    own = controllers.select(*KEY, F.col("address").alias("receiver"), F.lit(True).alias("ok")).distinct()
    return mints.join(own, [*KEY, "receiver"], "left").withColumn("paid", F.when(F.col("ok"), F.col("paid"))).withColumn("receiver", F.when(F.col("ok"), F.col("receiver"))).drop("ok")


def cost_stages(edges: DataFrame, honest: DataFrame) -> DataFrame:
    """chain, contract, stage, edges, gas: costs by stage, paid by the fee payer (or else the sender) unless honest."""
    stage = F.lit(None).cast("string")
    for channel, name in STAGE_OF.items():
        stage = F.when(F.col("channel") == channel, name).otherwise(stage)
    payer = F.when(F.trim(F.coalesce(F.col("payer").cast("string"), F.lit(""))) == "", F.col("src")).otherwise(F.col("payer"))
    own = edges.withColumn("stage", stage).withColumn("address", payer).where("stage IS NOT NULL").join(honest.select(*KEY, "address").distinct(), [*KEY, "address"], "left_anti")
    return own.groupBy(*KEY, "stage").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("gas"), 4).alias("gas"))


def stuck_time(held: DataFrame, bought: DataFrame, now: int) -> DataFrame:
    """chain, contract, tokens, paid, mean_seconds: what holders of bought tokens paid, and how long they have held them."""
    last = bought.groupBy(*KEY, "token", F.col("dst").alias("owner")).agg(F.max(F.struct("ts", "event_id", "usd")).alias("b"))
    return held.join(last, [*KEY, "token", "owner"]).groupBy(*KEY).agg(F.count(F.lit(1)).alias("tokens"), F.round(F.sum("b.usd"), 4).alias("paid"), F.round(F.avg(F.lit(now) - F.col("b.ts")), 2).alias("mean_seconds"))


def slug(c: Column) -> Column:
    """A file name of a title: words joined by underscores."""
    own = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_]+", "_"), r"^_+|_+$", "")
    return F.when(own == "", F.lit("unknown_collection")).otherwise(own)


def percent(c: Column) -> Column:
    return F.coalesce(F.concat(F.format_string("%.2f", c * 100), F.lit("%")), F.lit("n/a"))


def build_metadata(name: Column, description: Column, token_uri: Column, image: Column) -> Column:
    """Metadata JSON from the parts that are there; empty if none is."""
    parts = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("name", "description", "token_uri", "image"))), F.array(name, description, token_uri, image)), lambda k, v: v.isNotNull() & (v != ""))
    return F.when(F.size(parts) > 0, F.to_json(parts)).otherwise("")


def prefilter_terms(raw: Column) -> Column:
    """Distinct top-level keys, trait types and texts under the value keys of metadata JSON (one level deep), sorted."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    texts = F.array(*(F.lower(F.get_json_object(raw, f"$.{k}")) for k in VALUE_KEYS))
    traits = F.coalesce(F.from_json(F.lower(F.get_json_object(raw, "$.attributes[*].trait_type")), "array<string>"), F.array(F.lower(F.get_json_object(raw, "$.attributes[0].trait_type"))))
    every = F.concat(F.transform(keys, lambda k: F.lower(k)), texts, traits, F.when(F.size(F.filter(traits, lambda t: t.isNotNull())) > 0, F.array(F.lit("trait_type"))).otherwise(F.array().cast("array<string>")))
    return F.sort_array(F.array_distinct(F.filter(every, lambda t: t.isNotNull() & (t != ""))))


# Keys under which a text of metadata belongs to the flat document, at any depth.
FLAT_KEYS = frozenset("description trait_type value display_type image image_url animation_url external_url attributes metadata rawmetadata raw".split())


def flat_texts(raw: str | None) -> list[str] | None:
    """The texts below whitelisted keys of metadata JSON, at any depth and through lists; null for what is no JSON."""
    try:
        todo = [json.loads(raw)] if raw is not None else None
    except (ValueError, RecursionError):
        return None
    if todo is None:
        return None
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += [x[k] for k in sorted(x, reverse=True) if k.lower() in FLAT_KEYS]
        elif isinstance(x, list):
            todo += x[::-1]
        elif isinstance(x, str) and x.strip():
            out.append(x.strip())
    return out


@F.pandas_udf(ArrayType(StringType()))
def flat_texts_udf(raw: pd.Series) -> pd.Series:
    return raw.map(flat_texts, na_action="ignore")


def input_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A hash of names, sizes and times of change of all files below the paths; it changes when an input does."""
    seen = []
    for path in sorted(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.getFileStatus(where).isDirectory():
            files = system.listFiles(where, True)
            while files.hasNext():
                f = files.next()
                seen.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
        else:
            f = system.getFileStatus(where)
            seen.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def cached(spark: SparkSession, name: str, parameters: dict, inputs: list[str], make) -> DataFrame:
    """A table kept in the shared folder under a hash of its parameters and of its input files; it is made only if it is not there.

    It is written beside its place and renamed, so two writers do not disturb each other: the first one's table stays.
    """
    known = parameters | {"inputs": input_fingerprint(spark, inputs)}
    key = hashlib.sha256(json.dumps(known, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{scratch_dir(spark)}/cache/{name}-{key}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        make().write.parquet(own.toString())
        if not (not system.exists(where) and system.rename(own, where)):
            system.delete(own, True)
    return spark.read.parquet(path)
