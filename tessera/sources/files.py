"""Reading of snapshots and seeds, and publishing of reports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a snapshot.
SNAPSHOT = ("chain", "contract_address", "token_id", "name_norm", "token_uri_norm", "image_uri_norm", "metadata_json")


class SchemaError(ValueError):
    """A file lacks columns of the snapshot."""


def read_snapshot(spark: SparkSession, files: list[str], columns: tuple[str, ...] = SNAPSHOT, chains: list[str] | None = None) -> DataFrame:
    """Files, in the given order, as one table of strings with ``file_ordinal`` and ``row_index``: the source order.

    Only ``columns`` are read. A missing column is an error that names file and column; so is a chain list that leaves no row.
    """
    def look(path: str) -> tuple[dict[str, str], list[str]]:
        """Columns with their types, and files behind a path; only footers are read."""
        df = spark.read.parquet(path)
        return dict(df.dtypes), df.inputFiles()

    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(look, files))
    for path, (held, _) in zip(files, found, strict=True):
        if missing := [c for c in columns if c not in held]:
            raise SchemaError(f"{path}: no column {', '.join(missing)}")
    # one scan of all files of equal types (mostly one in all); their order is a small table, a row a file
    kinds: dict[tuple, list[str]] = {}
    for path, (held, _) in zip(files, found, strict=True):
        kinds.setdefault(tuple(held[c] for c in columns), []).append(path)
    same = F.regexp_replace(F.col("file_path"), "^file:/+", "file:///")
    order = spark.createDataFrame([(f, k) for k, (_, inside) in enumerate(found) for f in inside], "file_path string, file_ordinal int").withColumn("file_path", same)
    out = None
    for paths in kinds.values():
        scan = spark.read.parquet(*paths).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))
        one = scan.withColumn("file_path", same).join(F.broadcast(order), "file_path").select(*columns, "file_ordinal", "row_index")
        out = one if out is None else out.unionByName(one)
    if chains is not None:
        out = out.where(F.lower(F.trim("chain")).isin(*[c.strip().lower() for c in chains]))
        if out.limit(1).count() == 0:
            raise SchemaError(f"no row of chains {', '.join(chains)}")
    return out


def import_snapshot(df: DataFrame, folder: str) -> None:
    """Replaces the chains that ``df`` holds in a table partitioned by chain; other chains stay."""
    df.write.partitionBy("chain").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """chain, address, rank from JSON (an array of objects) or CSV with a header; repeated or empty seeds are an error."""
    raw = spark.read.option("multiLine", True).schema("chain string, address string, rank int").json(path) if path.endswith(".json") else spark.read.option("header", True).csv(path)
    chain = F.lower(F.trim("chain"))
    seeds = raw.select(chain.alias("chain"), F.when(chain == "solana", F.trim("address")).otherwise(F.lower(F.trim("address"))).alias("address"), (F.col("rank").cast("int") if "rank" in raw.columns else F.lit(None).cast("int")).alias("rank"))
    wrong = seeds.agg(F.count(F.when((F.coalesce("chain", F.lit("")) == "") | (F.coalesce("address", F.lit("")) == ""), 1)).alias("empty"), (F.count(F.lit(1)) - F.countDistinct("chain", "address")).alias("again")).first()
    if wrong["empty"] or wrong["again"]:
        raise SchemaError(f"{path}: {wrong['empty']} empty and {wrong['again']} repeated seeds")
    return seeds


def read_jdbc(spark: SparkSession, url: str, table: str, chain: str, blocks: tuple[int, int] | None = None, column: str = "block_number", parts: int = 32, properties: dict[str, str] | None = None) -> DataFrame:
    """A table of a database, read by ``parts`` tasks; of an EVM chain also an inclusive range of blocks, which the database filters.

    A range with a negative or descending bound is an error, and so is one for Solana, which has no such blocks.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **(properties or {}))
    if blocks is None:
        return reader.load()
    first, last = blocks
    if chain.strip().lower() == "solana":
        raise ValueError("a range of blocks is only for EVM chains")
    if first < 0 or last < first:
        raise ValueError(f"no range of blocks: {first} to {last}")
    ranged = reader.options(partitionColumn=column, lowerBound=str(first), upperBound=str(last + 1), numPartitions=str(max(1, min(parts, last - first + 1))))
    return ranged.load().where(F.col(column).between(first, last))


def export_jdbc(spark: SparkSession, folder: str, **source) -> None:
    """As ``read_jdbc``, written to a table partitioned by chain; the chains it holds are replaced."""
    import_snapshot(read_jdbc(spark, **source), folder)


def write_artifacts(df: DataFrame, keys: list[str], folder: str, compression: str = "gzip") -> None:
    """JSON by seed, candidate or scope: one folder for each value of the keys, compressed (zstd where Hadoop's native library has it).

    Rows of one key may be many: they are spread over files of at most a million rows.
    """
    df.write.partitionBy(*keys).mode("overwrite").option("compression", compression).option("maxRecordsPerFile", 1_000_000).json(folder)


def publish(spark: SparkSession, reports: dict[str, DataFrame], folder: str) -> None:
    """Writes all reports (a name ends in .csv or .json) to a staging folder, then puts it in the place of ``folder``.

    What was there is kept until the new one stands, and comes back if that fails. ``_SUCCESS`` is written last. Reports are
    small: each is one sorted file.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    target, staging, backup = path(folder), path(folder.rstrip("/") + ".staging"), path(folder.rstrip("/") + ".backup")
    fs = target.getFileSystem(conf)
    fs.delete(staging, True)
    for name, df in reports.items():
        one = df.orderBy(*df.columns[:3]).coalesce(1).write.mode("overwrite")
        where = f"{staging.toString()}/{name}"
        one.option("header", True).csv(where) if name.endswith(".csv") else one.json(where)
    fs.create(path(staging, "_SUCCESS")).close()
    fs.delete(backup, True)
    had = fs.exists(target)
    if had:
        fs.rename(target, backup)
    if not fs.rename(staging, target):
        if had:
            fs.rename(backup, target)
        raise OSError(f"cannot publish {folder}")
    fs.delete(backup, True)


def summary_report(scopes: DataFrame) -> DataFrame:
    """The nine columns of the summary, from scope counts with ratios."""
    name = F.when(F.col("scope") == "intra", "intra_chain").otherwise("cross_chain_summary")
    own = scopes.where("scope != 'matrix'").select(F.col("chain").alias("primary_chain"), name.alias("scope"), "dimension", "contracts", F.coalesce("contract_ratio", F.lit(0.0)).alias("contract_ratio"), "nfts", F.coalesce("nft_ratio", F.lit(0.0)).alias("nft_ratio"), "total_contracts", "total_nfts")
    # fixed values: the names of the columns
    return own.toDF("primary_chain", "scope", "dimension", "duplicate_contract_count", "duplicate_contract_ratio", "duplicate_nft_count", "duplicate_nft_ratio", "total_contracts", "total_nfts")


def matrix_report(scopes: DataFrame) -> DataFrame:
    own = scopes.where("scope = 'matrix'").select("chain", "peer", "dimension", "contracts", "contract_ratio", "nfts", "nft_ratio", "total_contracts", "total_nfts")
    # fixed values: the names of the columns
    return own.toDF("primary_chain", "secondary_chain", "dimension", "duplicate_contract_count", "duplicate_contract_ratio", "duplicate_nft_count", "duplicate_nft_ratio", "total_contracts", "total_nfts")


def markdown(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A report table as Markdown. Reports hold a row for each scope; a table of more than ``most`` rows is no report, and an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows")
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)
