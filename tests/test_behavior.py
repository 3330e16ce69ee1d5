"""Small graphs with known components and behaviour."""

import random

import pytest

from tessera.operators import behavior, economics, extra, graphs

MOVES = "event_id long, chain string, contract string, token long, src string, dst string, ts long, is_sale boolean, usd double"


def moves(spark, rows):
    return spark.createDataFrame([(i, "base", "c", t, a, b, ts, usd is not None, usd) for i, (t, a, b, ts, usd) in enumerate(rows)], MOVES)


def components_of(df):
    return {r.address: r.component for r in df.collect()}


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for n in nodes:
                if a in reach[n] and b not in reach[n]:
                    reach[n].add(b)
                    changed = True
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("limit", [1000, 0])
def test_components_by_both_methods(spark, limit):
    rng = random.Random(2)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(22)}
    edges = sorted((a, b) for a, b in edges if a != b)
    graph = spark.createDataFrame([("base", "c", a, b) for a, b in edges], "chain string, contract string, src long, dst long")
    assert components_of(graphs.strong_components(graph, limit)) == brute_components(edges)


@pytest.mark.parametrize("limit", [1000, 0])
def test_components_of_chains_with_cycles_at_their_ends(spark, limit):
    edges = [(i, i + 1) for i in range(12)] + [(12, 10), (2, 0), (40, 41), (41, 42), (50, 51), (51, 50)]
    graph = spark.createDataFrame([("base", "c", a, b) for a, b in edges], "chain string, contract string, src long, dst long")
    assert components_of(graphs.strong_components(graph, limit)) == brute_components(edges)


def test_components_of_nothing(spark):
    empty = spark.createDataFrame([], "chain string, contract string, src long, dst long")
    assert graphs.strong_components(empty).count() == 0 and graphs.degrees(empty).count() == 0


def test_wash_cycle_and_exit(spark):
    m = moves(spark, [(1, "a", "b", 1, 1.0), (1, "b", "a", 2, 2.0), (1, "a", "v", 5, 50.0)])
    held = behavior.holders(m)
    role = behavior.roles(m, held)
    assert {r.address: r.role for r in role.collect()} == {"a": "operator", "b": "operator", "v": "victim"}
    cycles = behavior.wash_cycles(m, role)
    assert {r.address for r in cycles.collect()} == {"a", "b"}
    facts = behavior.cycle_facts(m, cycles)
    out = behavior.pump_and_exit(m, role, cycles, facts).first()
    assert (out.exits, out.buyers, out.exit_usd, out.delay) == (1, 1, 50.0, 3) and abs(out.ratio - 50 / 1.5) < 1e-6


def test_exit_needs_prices_and_time(spark):
    for last in (("v", 2, 50.0), ("v", 5, None)):
        m = moves(spark, [(1, "a", "b", 1, 1.0), (1, "b", "a", 2, 2.0), (1, "a", last[0], last[1], last[2])])
        held = behavior.holders(m)
        role = behavior.roles(m, held)
        cycles = behavior.wash_cycles(m, role)
        assert behavior.pump_and_exit(m, role, cycles, behavior.cycle_facts(m, cycles)).count() == 0


def test_stars(spark):
    star = [(1, "o", x, i, None) for i, x in enumerate("pqr")]
    kinds = {}
    for name, more in (("poisoning", []), ("fraud_revenue", [(1, "o", "p", 9, 5.0)]), ("sybil_distribution", [(1, "p", "z", 9, None)])):
        m = moves(spark, star + more)
        role = behavior.roles(m, behavior.holders(m))
        kinds[name] = [r.kind for r in behavior.star_behaviors(m, role).collect()]
    assert kinds == {k: [k] for k in kinds}


def test_layered_path_takes_the_first_of_rising_time(spark):
    m = moves(spark, [(1, "o", "a", 1, None), (1, "a", "b", 1, None), (1, "a", "c", 3, None), (1, "a", "d", 2, None), (1, "a", "o", 2, None)])
    role = spark.createDataFrame([("base", "c", "o", "operator")], "chain string, contract string, address string, role string")
    r = behavior.layered(m, role).first()
    assert (r.start, r.middle, r.end) == ("o", "a", "d")


@pytest.mark.parametrize("length", [3, 4, 5])
def test_layered_paths_equal_depth_first_search(spark, length):
    rng = random.Random(length)
    rows = sorted({(rng.randint(1, 2), rng.choice("abcdef"), rng.choice("abcdef"), rng.randint(1, 9), rng.choice([None, 0.5, 5.0])) for _ in range(60)}, key=repr)
    m = moves(spark, [r for r in rows if r[1] != r[2]])
    events = [r.asDict() for r in m.collect()]
    starts = spark.createDataFrame([("base", "c", a) for a in "abc"], "chain string, contract string, address string")

    def search(token, path, selected):
        if len(path) == length:
            return path, selected
        for e in sorted((e for e in events if e["token"] == token and e["src"] == path[-1]), key=lambda e: (e["ts"], e["event_id"])):
            if e["dst"] in path or (selected and e["ts"] <= selected[-1]["ts"]):
                continue
            found = search(token, [*path, e["dst"]], [*selected, e])
            if found:
                return found
        return None

    want = {}
    for token in {e["token"] for e in events}:
        for a in "abc":
            if found := search(token, [a], []):
                want[token, a] = (found[0], sum(not e["is_sale"] or (e["usd"] is not None and 0 <= e["usd"] <= 1) for e in found[1]))
    got = {(r.token, r.start): (r.path, r.low_value_hops) for r in graphs.layered_paths(m, starts, length).collect()}
    assert got == want


def test_gini_and_top_share(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 1), ("y", 0), ("z", 1), ("z", 3)], "k string, v long")
    assert {r.k: r.gini for r in behavior.gini(rows, ["k"], "v").collect()} == {"x": 0.0, "y": None, "z": 0.25}
    got = behavior.top_share(spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double"), "v").first()
    assert (got.top_n, got.top_total, got.total) == (2, 39.0, 210.0)


def test_money_counts_once(spark):
    rows = [("base", "c", 1, "t", "a", "b", "sale", 5.0)] * 2 + [("base", "c", 1, "", "a", "b", "sale", 5.0)] * 2 + [("base", "c", 2, "t", "a", "b", "sale", 5.0)]
    df = spark.createDataFrame(rows, "chain string, contract string, token long, tx string, src string, dst string, kind string, usd double")
    assert economics.money_sum(df, ["chain", "contract"]).first()[2:] == (4, 20.0)


def test_campaigns_and_trace(spark):
    e = spark.createDataFrame([("c1", "x"), ("c2", "x"), ("c2", "y"), ("c3", "y"), ("c9", "z")], "contract string, evidence string")
    assert {r.contract: r.campaign for r in extra.campaigns(e).collect()} == {"c1": "c1", "c2": "c1", "c3": "c1"}
    rows = [(0, "a", "b", 100.0, "ETH", 1, 0), (1, "b", "c", 90.0, "ETH", 2, 0), (2, "b", "d", 1.0, "ETH", 3, 0), (3, "c", "e", 200.0, "ETH", 3, 0), (4, "c", "f", 80.0, "ETH", 2, 1), (5, "b", "g", 50.0, "USDC", 5, 0)]
    rows += [(6, "b", "h", 60.0, "ETH", 1, 0), (7, "b", "b", 60.0, "ETH", 4, 0), (8, "f", "a", 70.0, "ETH", 2, 1), (9, "f", "i", 70.0, "ETH", 2, 2)]
    paid = spark.createDataFrame(rows, "event_id long, src string, dst string, usd double, currency string, block long, place long")
    got = sorted((r.hop, r.event_id, r.dst) for r in extra.trace(paid, paid.where("event_id = 0").select("event_id")).collect())
    assert got == [(0, 0, "b"), (1, 1, "c"), (2, 4, "f"), (3, 9, "i")]


def test_legitimate(spark):
    s = spark.createDataFrame([("base", "a", True, False), ("base", "a", None, True), ("base", "b", False, None)], "chain string, contract string, x boolean, y boolean")
    assert {r.contract: r.state for r in economics.legitimate(s, ["x", "y"]).collect()} == {"a": "legitimate", "b": "suspected"}
