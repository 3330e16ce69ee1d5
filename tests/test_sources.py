"""Snapshots, seeds, reports, logs, accounts and incremental intake."""

import os

import pytest

from tessera.sources import chain_logs, files
from tessera.streaming.incremental import append_new

ROW = ("Base", "0xA", "1", "n", "u", "i", "{}")


def test_snapshot_order_and_validation(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([ROW, (None,) + ROW[1:]], ", ".join(f"{c} string" for c in files.SNAPSHOT)).coalesce(1).write.parquet(a)
    spark.createDataFrame([(*ROW[:2], 7, *ROW[3:])], ", ".join(f"{c} {'long' if c == 'token_id' else 'string'}" for c in files.SNAPSHOT)).write.parquet(b)
    rows = files.read_snapshot(spark, [b, a]).orderBy("file_ordinal", "row_index").collect()
    assert [(r.file_ordinal, r.token_id, r.chain) for r in rows] == [(0, "7", "Base"), (1, "1", "Base"), (1, "1", "")]
    assert files.read_snapshot(spark, [a], chains=["BASE "]).count() == 1
    with pytest.raises(files.SchemaError):
        files.read_snapshot(spark, [a], chains=["solana"])
    spark.createDataFrame([("x",)], "chain string").write.parquet(str(tmp_path / "c"))
    with pytest.raises(files.SchemaError, match="token_id"):
        files.read_snapshot(spark, [str(tmp_path / "c")])


def test_import_replaces_only_its_chains(spark, tmp_path):
    to = str(tmp_path / "t")
    files.import_snapshot(spark.createDataFrame([("base", 1), ("solana", 2)], "chain string, n long"), to)
    files.import_snapshot(spark.createDataFrame([("base", 3)], "chain string, n long"), to)
    assert {(r.chain, r.n) for r in spark.read.parquet(to).collect()} == {("base", 3), ("solana", 2)}


def test_seeds(spark, tmp_path):
    good = tmp_path / "s.json"
    good.write_text('[{"chain": " Base", "address": "0xAB", "rank": 1}, {"chain": "solana", "address": "AbC"}]')
    assert {(r.chain, r.address, r["rank"]) for r in files.read_seeds(spark, str(good)).collect()} == {("base", "0xab", 1), ("solana", "AbC", None)}
    bad = tmp_path / "s.csv"
    bad.write_text("chain,address\nbase,0xAB\nBASE,0xab\n")
    with pytest.raises(files.SchemaError):
        files.read_seeds(spark, str(bad))


def test_publish_replaces_whole_folders(spark, tmp_path):
    to = str(tmp_path / "report")
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n long")
    files.publish(spark, {"old.csv": df}, to)
    files.publish(spark, {"summary.csv": df, "rows.json": df}, to)
    assert os.path.exists(f"{to}/_SUCCESS") and not os.path.exists(f"{to}/old.csv") and not os.path.exists(to + ".staging")
    assert [r.k for r in spark.read.option("header", True).csv(f"{to}/summary.csv").collect()] == ["a", "b"]
    assert files.markdown(df.orderBy("k"), "T").splitlines()[-1] == "| b | 2 |"


def test_logs(spark):
    def word(n):
        return f"{n:064x}"

    z = "0x" + "0" * 64
    big = 2**255 + 1
    rows = [
        ("0xA", [chain_logs.ERC721_TRANSFER, z, z, "0x" + word(big)], "0x"),
        ("0xA", [chain_logs.ERC721_TRANSFER, z, z], "0x" + word(5)),
        ("0xB", [chain_logs.ERC1155_SINGLE, z, z, z], "0x" + word(7) + word(1)),
        ("0xB", [chain_logs.ERC1155_SINGLE, z, z, z], "0x"),
        ("0xC", [chain_logs.ERC1155_BATCH, z, z, z], "0x" + word(64) + word(0) + word(3) + word(0) + word(9)),
        ("0xC", [chain_logs.ERC1155_BATCH, z, z, z], "0x" + word(6400) + word(0)),
        (None, None, None),
        ("0xD", ["0x00", z, z, z], None),
    ]
    got = chain_logs.decode_transfers(spark.createDataFrame(rows, "address string, topics array<string>, data string")).collect()
    assert sorted((r.contract, r.token, r.standard) for r in got) == [("0xa", f"{big:x}", "ERC-721"), ("0xb", "7", "ERC-1155"), ("0xc", "0", "ERC-1155"), ("0xc", "9", "ERC-1155")]


def test_accounts_and_images():
    def text(s):
        return len(s).to_bytes(4, "little") + s

    head = bytes([4]) + bytes(32) + bytes([1] * 32)
    body = text(b"Name\0\0") + text(b"SYM") + text(b"ipfs://x") + b"\0\0"
    tail = bytes([1]) + (2).to_bytes(4, "little") + bytes(68) + b"\1\1" + b"\1\5" + b"\0" + b"\1\1" + bytes([2] * 32)
    got = chain_logs.metadata_account(head + body + tail)
    assert (got["name"], got["symbol"], got["uri"]) == ("Name", "SYM", "ipfs://x") and got["collection"] == chain_logs.base58(bytes([2] * 32))
    assert chain_logs.metadata_account(b"\5" + head[1:] + body) is None and chain_logs.metadata_account(None) is None
    assert chain_logs.image_uri('{"properties": {"files": [{"uri": "v"}, {"uri": "p", "type": "image/png"}]}}') == "p"
    assert chain_logs.image_uri('{"image_url": " u "}') == "u" and chain_logs.image_uri("[") is None and chain_logs.image_uri(None) is None
    assert chain_logs.inline_image("data:application/json,%7B%22image%22%3A%22x%22%7D") == "x"


def test_append_new_is_exactly_once(spark, tmp_path):
    source, target, mark = str(tmp_path / "s"), str(tmp_path / "t"), str(tmp_path / "c")
    for rows in ([(1, "a"), (2, "b"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(rows, "k long, v string").write.mode("append").parquet(source)
        append_new(spark, source, "k long, v string", target, ["k"], mark).awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_cached_tables_follow_their_inputs(spark, tmp_path):
    from tessera.operators import evidence

    source = str(tmp_path / "in.parquet")

    def make():
        return spark.read.parquet(source)

    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(source)
        for _ in range(2):
            assert evidence.cached(spark, "t", {"v": str(tmp_path)}, [source], make).count() == n


def test_hashes():
    from tessera.functions import hashing

    h = hashing.OFFSET
    for b in "é".encode():
        h = (h ^ b) * hashing.PRIME % 2**64
    assert hashing.token_hash("é") == hashing.mixed(h) and hashing.token_hash("") == hashing.mixed(hashing.OFFSET)


def test_scratch_is_never_local_on_a_cluster():
    from types import SimpleNamespace

    from tessera import runtime

    class Conf:
        def get(self, key, default=None):
            return default

    for master, fine in (("local[4]", True), ("local", True), ("local-cluster[2,1,512]", False), ("spark://x:7077", False), ("yarn", False)):
        session = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master, getConf=lambda: Conf()))
        if fine:
            assert runtime.scratch_dir(session)
        else:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                runtime.scratch_dir(session)


def test_jdbc_reads_ranges_of_blocks():
    from types import SimpleNamespace

    seen = {}

    class Reader:
        def format(self, kind):
            seen["kind"] = kind
            return self

        def options(self, **o):
            seen.update(o)
            return self

        def load(self):
            return SimpleNamespace(where=lambda c: "filtered")

    session = SimpleNamespace(read=Reader())
    for chain, blocks in (("solana", (1, 2)), ("base", (-1, 2)), ("base", (5, 4))):
        with pytest.raises(ValueError):
            files.read_jdbc(session, "jdbc:x", "t", chain, blocks)
    assert files.read_jdbc(session, "jdbc:x", "t", "solana") is not None and "partitionColumn" not in seen


def test_artifacts_are_written_by_key(spark, tmp_path):
    df = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2), ("s2", "a", 3)], "seed string, candidate string, n int")
    files.write_artifacts(df, ["seed", "candidate"], str(tmp_path / "out"))
    assert sorted((r.seed, r.candidate, r.n) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("s1", "a", 1), ("s1", "b", 2), ("s2", "a", 3)]
    assert [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".json.gz")]
