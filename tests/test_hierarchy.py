import random

from jurisgrid.operators.hierarchy import descendant_pairs, resolve_hierarchy

NODES = "fiche_id long, canonical_id string, parent_id string, extra int"


def brute(rows):
    """path, root, depth, cycle of every node by walking up."""
    up = {(g, n.strip().lower()): (p or "").strip().lower() for g, n, p, _ in rows}
    out = {}
    for g, n in up:
        way, at = [n], n
        while (g, up[(g, at)]) in up and up[(g, at)] not in way:
            at = up[(g, at)]
            way.append(at)
        nxt = up[(g, at)]
        if (g, nxt) in up:  # a loop
            loop = way[way.index(nxt) :]
            out[(g, n)] = min(loop)
        else:
            out[(g, n)] = way[::-1]
    return out


def test_random_forests_with_loops(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        n = rng.randrange(1, 40)
        for i in range(n):
            kind = rng.random()
            parent = f"n{rng.randrange(n)}" if g % 3 == 0 else (f"N{rng.randrange(i)} " if i and kind < 0.9 else None if kind < 0.95 else "gone")
            rows.append((g, f"n{i}", parent, 1))
    rows += rows[:5]
    rows += [(None, "n1", None, 1), (1, None, "n0", 1), (50, "only", " ", 1), (60, "self", "self", 1)]
    clean = [r for r in rows if r[0] is not None and r[1] is not None]
    want = brute(clean)
    got = {(r["fiche_id"], r["canonical_id"]): r for r in resolve_hierarchy(spark.createDataFrame(rows, NODES)).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        r = got[k]
        if isinstance(w, str):
            assert r["cycle_id"] == w
        else:
            assert r["cycle_id"] is None and r["path"].split("/") == w and r["depth"] == len(w) - 1 and r["root"] == w[0]
    # Intervals nest as ancestors do.
    for (g, a), ra in got.items():
        inside = {n for (h, n), r in got.items() if h == g and r["root"] == ra["root"] and ra["entry"] < r["entry"] and r["exit"] < ra["exit"]}
        assert len(inside) == ra["descendants"] and inside == {n for (h, n), r in got.items() if h == g and n != a and a in r["path"].split("/")[: r["depth"]]}


def test_deep_chain_and_empty(spark):
    n = 300
    rows = [(1, f"c{i:04d}", f"c{i - 1:04d}" if i else None, 0) for i in range(n)]
    out = resolve_hierarchy(spark.createDataFrame(rows, NODES))
    assert out.agg({"depth": "max"}).first()[0] == n - 1
    assert descendant_pairs(out).count() == n * (n - 1) // 2
    assert resolve_hierarchy(spark.createDataFrame([], NODES)).count() == 0


def test_parent_known_only_as_element(spark):
    rows = spark.createDataFrame([(1, "A", "B", 0)], NODES)
    elements = spark.createDataFrame([(1, "A"), (1, "b ")], "fiche_id long, canonical_id string")
    got = {r["canonical_id"]: r for r in resolve_hierarchy(rows, elements).collect()}
    assert got["A"]["root"] == "b" and got["b"]["implicit"] and got["A"]["depth"] == 1


def test_ids_with_odd_blanks_and_slashes(spark):
    """Loops are opened at their smallest node whatever blanks its id has; an id may hold the path's separator."""
    rows = [(1, "B", "A", 0), (1, "A ", "B", 0), (1, "C", "\tb ", 0), (2, "A/1", None, 0), (2, "A/1/x", "A/1", 0), (2, "y", "A/1/x", 0)]
    out = resolve_hierarchy(spark.createDataFrame(rows, NODES))
    got = {(r["fiche_id"], r["canonical_id"].strip(" \t ")): r for r in out.collect()}
    assert len(got) == 6 and got[(1, "C")]["depth"] == 2 and got[(1, "A")]["depth"] == 0 and got[(1, "B")]["cycle_id"].startswith("A") and got[(1, "C")]["cycle_id"].startswith("A")
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in descendant_pairs(out).where("fiche_id = 2").collect()}
    assert pairs == {("A/1", "A/1/x", 1), ("A/1", "y", 2), ("A/1/x", "y", 1)}
