"""Walks and caller chains against plain versions, on random graphs with cycles, deep paths and a hub."""

import random

import pytest
from pyspark.sql import functions as F

from factspan.operators import chains, graph


def distances(edges, seed):
    after, seen, level, depth = {}, {seed: 0}, [seed], 0
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    while level:
        depth += 1
        level = sorted({b for a in level for b in after.get(a, ()) if b not in seen})
        seen.update({b: depth for b in level})
    return {node: d for node, d in seen.items() if d}


def test_closure_of_deep_paths_and_cycles(spark):
    draw = random.Random(3)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(1000)]
    # Branches, a short cut past many nodes, a long cycle, self-loops, and twigs that lead back.
    edges += [("n100", "b0"), *((f"b{i}", f"b{i + 1}") for i in range(40)), ("b40", "n900"), ("n1000", "c0"), *((f"c{i}", f"c{(i + 1) % 300}") for i in range(300))]
    edges += [("n5", "n5"), ("b3", "b1")] + [(f"x{draw.randrange(30)}", f"x{draw.randrange(30)}") for _ in range(70)] + [("x3", "n990")]
    df = spark.createDataFrame(edges + edges[:10], "s string, d string")
    seeds = ["n0", "n500", "c7", "x1", "x3", "b2", "absent"]
    asked = spark.createDataFrame([(s, s) for s in seeds], "target_id string, node string")
    for most in (None, 3, 120):
        got = {(r.target_id, r.node): r.depth for r in graph.closure(df, asked, "s", "d", max_depth=most).collect()}
        assert got == {(s, n): d for s in seeds for n, d in distances(edges, s).items() if most is None or d <= most}


def every_chain(symbol, callers, places, depth, limit):
    done, going = [], [[symbol]]
    while going:
        chain = going.pop()
        if chain[-1] in chain[:-1]:
            done.append((chain, "cycle-detected"))
        elif len(chain) > depth:
            done.append((chain, "depth-limit"))
        elif not callers.get(chain[-1]):
            done.append((chain, "no-upstream-callers"))
        else:
            going += [[*chain, n] for n in callers[chain[-1]]]
    place = lambda c: (c[-1] in places, places.get(c[-1], 0))
    return sorted(done, key=lambda x: (len(x[0]), place(x[0]), x[0]))[:limit]


@pytest.mark.parametrize("seed,symbols,calls,depth,limit", [(1, 12, 60, 3, 4), (2, 30, 60, 3, 12), (3, 7, 40, 4, 3), (4, 40, 50, 2, 5), (5, 9, 30, 5, 2)])
def test_chains_are_the_first_of_all(spark, seed, symbols, calls, depth, limit):
    draw = random.Random(seed)
    edges = [(f"s{draw.randrange(symbols)}", f"s{draw.randrange(symbols)}") for _ in range(calls)]
    # Two symbols that call each other and through which most others must go.
    edges += [("s0", "s1"), ("s1", "s0")] + [(f"z{i}", "s0") for i in range(10)]
    places = {f"s{i}": draw.randrange(100) for i in range(symbols) if i % 5}
    callers = {}
    for caller, callee in edges:
        callers.setdefault(callee, set()).add(caller)
    asked = [f"s{i}" for i in range(symbols)] + ["none"]
    got = chains.upstream_chains(
        spark.createDataFrame([(s, s) for s in asked], "target_id string, symbol_id string"),
        spark.createDataFrame(edges, "caller_id string, callee_id string"),
        spark.createDataFrame([(s, "p", n, 1) for s, n in places.items()], "symbol_id string, path string, line int, column int"), depth, limit,
    )
    rows = {}
    for r in got.collect():
        rows.setdefault(r.target_id, []).append((r.position, list(r.chain), r.end_reason))
        assert r.terminal_id == r.chain[-1] and r.chain_length == len(r.chain)
    for s in asked:
        want = [(k, c, e) for k, (c, e) in enumerate(every_chain(s, callers, places, depth, limit), 1)]
        assert sorted(rows.get(s, [])) == want


def test_a_hub_with_many_callers_and_callees(spark):
    """100,000 symbols call the hub, which calls 100,000 others: 10^10 chains of two steps, of which a few are kept."""
    n = 100_000
    ids = spark.range(n)
    into = ids.select(F.concat(F.lit("a"), F.col("id")).alias("caller_id"), F.lit("hub").alias("callee_id"))
    out = ids.select(F.lit("hub").alias("caller_id"), F.concat(F.lit("b"), F.col("id")).alias("callee_id"))
    back = ids.select(F.concat(F.lit("c"), F.col("id")).alias("caller_id"), F.concat(F.lit("a"), F.col("id") % 1000).alias("callee_id"))
    edges = into.unionByName(out).unionByName(back).unionByName(spark.createDataFrame([("hub", "a500")], into.schema))
    places = edges.select(F.col("caller_id").alias("symbol_id"), F.lit("p").alias("path"), F.hash("caller_id").alias("line"), F.lit(1).alias("column")).distinct()
    asked = ids.select(F.concat(F.lit("t"), F.col("id")).alias("target_id"), F.concat(F.lit("b"), F.col("id")).alias("symbol_id"))
    asked = asked.unionByName(spark.createDataFrame([("h", "hub")], asked.schema))
    got = chains.upstream_chains(asked, edges, places, depth=3, limit=5)
    counts = got.groupBy("chain_length", "end_reason").count().collect()
    assert sum(r["count"] for r in counts) == 5 * (n + 1)
    line = {r.symbol_id: r.line for r in places.collect()}
    ends = sorted((line[f"a{i}"], f"a{i}") for i in range(1000, n))[:5]
    want = [["b7", "hub", a] for _, a in ends]
    assert [list(r.chain) for r in got.filter("target_id = 't7'").orderBy("position").collect()] == want
    assert [list(r.chain) for r in got.filter("target_id = 'h'").orderBy("position").collect()] == [c[1:] for c in want]
