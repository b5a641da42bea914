"""Parent-child rows to full hierarchies: cycles, Euler tours, depth, paths, descendants.

Nothing gathers a tree in one task. Leaves are peeled by doubling: after round k only nodes that
have a descendant 2^k steps below are still the target of a jump, so what is left after log2(n)
rounds are exactly the loops. A loop is opened at its smallest id, and every tree then becomes
a linked list of its enter and exit events (the Euler tour), ranked by pointer jumping in log2(length)
rounds of equi-joins on (group, event). The order of siblings comes from one range sort
(:func:`jurisgrid.common.global_rank`), not from a window over a parent's children, so a parent
with a third of all rows is no hot spot. Every round is written to the shared checkpoint
folder, which replaces the round before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurisgrid.common import cut, global_rank, id_key

MAX_ROUNDS = 62


def build_nodes(rows: DataFrame, elements: DataFrame | None, group: str, node: str, parent: str) -> DataFrame:
    """Distinct nodes (grp, key, id, parent) with resolved parents.

    Ids are compared without case and surrounding blanks. A null or blank parent, or one that
    neither ``elements`` nor ``rows`` has, makes a root. A parent that only ``elements`` has becomes
    a node of its own (implicit). If a node comes several times the alphabetically smallest spelling
    and the smallest parent are kept; rows with a null group or node are dropped, as they name no node.
    """
    own = (
        rows.select(F.col(group).alias("grp"), id_key(F.col(node)).alias("key"), F.trim(F.col(node)).alias("id"), id_key(F.col(parent)).alias("up"))
        .where("grp is not null and key is not null")
        .groupBy("grp", "key")
        .agg(F.min("id").alias("id"), F.min("up").alias("up"))
    )
    known = own.select("grp", "key", "id", F.lit(True).alias("own"))
    if elements is not None:
        more = elements.select(F.col(group).alias("grp"), id_key(F.col(node)).alias("key"), F.trim(F.col(node)).alias("id"), F.lit(False).alias("own")).where("grp is not null and key is not null")
        known = known.unionByName(more).groupBy("grp", "key").agg(F.min("id").alias("id"), F.max("own").alias("own"))
    linked = own.join(known.select("grp", F.col("key").alias("up"), F.col("own").alias("up_own"), F.col("id").alias("up_id")), ["grp", "up"], "left").select("grp", "key", "id", F.when(F.col("up_own").isNotNull(), F.col("up")).alias("parent"), "up_own", "up_id")
    linked = cut(linked)
    implicit = linked.where("not up_own").groupBy("grp", F.col("parent").alias("key")).agg(F.min("up_id").alias("id")).select("grp", "key", "id", F.lit(None).cast("string").alias("parent"), F.lit(True).alias("implicit"))
    return linked.select("grp", "key", "id", "parent", F.lit(False).alias("implicit")).unionByName(implicit)


def peel(nodes: DataFrame) -> DataFrame:
    """Nodes whose chain of parents never ends: (grp, key, cycle_id, cycle_key, on_cycle).

    ``jump`` is the node 2^k steps up and ``low`` the smallest id on those steps. Rows whose jump
    leaves the tree are dropped, so a round costs only what is still alive. After the jump is at
    least as long as the largest group, every jump ends on a loop and ``low`` of a node on a loop
    is the smallest id of the whole loop, ``low_key`` the key of that node.
    """
    base = nodes.where("parent is not null").select("grp", "key", F.col("parent").alias("jump"), F.col("id").alias("low"), F.col("key").alias("low_key"))
    alive = cut(base)
    span = 1
    for _ in range(MAX_ROUNDS):
        # A group without a living row is a tree; its size no longer counts.
        largest = alive.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if largest is None or span > largest:
            break
        nxt = alive.select("grp", F.col("key").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"), F.col("low_key").alias("low_key2"))
        lower = (F.col("low2") < F.col("low")) | (F.col("low2") == F.col("low")) & (F.col("low_key2") < F.col("low_key"))
        pick = lambda c: F.when(lower, F.col(f"{c}2")).otherwise(F.col(c)).alias(c)
        alive = cut(alive.join(nxt, ["grp", "jump"]).select("grp", "key", F.col("jump2").alias("jump"), pick("low"), pick("low_key")), alive)
        span *= 2
    loops = alive.groupBy("grp", F.col("jump").alias("key")).agg(F.lit(True).alias("on_cycle"))
    on = loops.join(alive.select("grp", "key", "low", "low_key"), ["grp", "key"]).select("grp", F.col("key").alias("jump"), F.col("low").alias("cycle_id"), F.col("low_key").alias("cycle_key"))
    found = alive.join(on, ["grp", "jump"]).select("grp", "key", "cycle_id", "cycle_key")
    return found.join(loops, ["grp", "key"], "left").select("grp", "key", "cycle_id", "cycle_key", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def euler_tours(nodes: DataFrame) -> DataFrame:
    """(grp, key, id, parent, implicit, root, entry, exit, depth, descendants) of a forest.

    ``entry`` and ``exit`` count from 0 in the tour of the node's own tree, so u is an ancestor of v
    exactly when both have one root and u.entry < v.entry and v.exit < u.exit.
    """
    ranked = global_rank(nodes.withColumn("up", F.coalesce("parent", F.lit(""))), ["grp", "up", "key"], "at")
    ranked = cut(ranked)
    nxt = ranked.select((F.col("at") - 1).alias("at"), F.col("grp").alias("g2"), F.col("up").alias("u2"), F.col("key").alias("k2"))
    sib = ranked.join(nxt, "at", "left").withColumn("sibling", F.when((F.col("g2") == F.col("grp")) & (F.col("u2") == F.col("up")) & (F.col("up") != ""), F.col("k2"))).drop("g2", "u2", "k2")
    first = nodes.where("parent is not null").groupBy("grp", F.col("parent").alias("key")).agg(F.min("key").alias("child"))
    tree = cut(sib.join(first, ["grp", "key"], "left"))
    # Events: "+key" enters a node, "-key" leaves it. tail is the last event reached so far.
    enter = tree.select("grp", F.concat(F.lit("+"), "key").alias("ev"), F.when(F.col("child").isNotNull(), F.concat(F.lit("+"), "child")).otherwise(F.concat(F.lit("-"), "key")).alias("nxt"), F.lit(1).cast("long").alias("w"))
    leave = tree.select("grp", F.concat(F.lit("-"), "key").alias("ev"), F.when(F.col("sibling").isNotNull(), F.concat(F.lit("+"), "sibling")).when(F.col("parent").isNotNull(), F.concat(F.lit("-"), "parent")).alias("nxt"), F.lit(-1).cast("long").alias("w"))
    links = cut(enter.unionByName(leave).select("grp", "ev", "nxt", "w", F.lit(1).cast("long").alias("n"), F.col("ev").alias("tail")))
    for _ in range(MAX_ROUNDS):
        if not links.where("nxt is not null").take(1):
            break
        ahead = links.select("grp", F.col("ev").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("w").alias("w2"), F.col("n").alias("n2"), F.col("tail").alias("tail2"))
        moved = links.where("nxt is not null").join(ahead, ["grp", "nxt"]).select("grp", "ev", F.col("nxt2").alias("nxt"), (F.col("w") + F.col("w2")).alias("w"), (F.col("n") + F.col("n2")).alias("n"), F.col("tail2").alias("tail"))
        links = cut(moved.unionByName(links.where("nxt is null")), links)
    # n events remain from here to the end of the tour, w is their sum: position and depth follow.
    down = links.where("ev like '+%'").select("grp", F.substring("ev", 2, 1 << 30).alias("key"), "n", F.substring("tail", 2, 1 << 30).alias("root"), (-F.col("w")).alias("depth"))
    up = links.where("ev like '-%'").select("grp", F.substring("ev", 2, 1 << 30).alias("key"), F.col("n").alias("n_exit"))
    size = down.where("key = root").select("grp", "root", F.col("n").alias("total"))
    return (
        tree.select("grp", "key", "id", "parent", "implicit")
        .join(down, ["grp", "key"])
        .join(up, ["grp", "key"])
        .join(size, ["grp", "root"])
        .select("grp", "key", "id", "parent", "implicit", "root", (F.col("total") - F.col("n")).alias("entry"), (F.col("total") - F.col("n_exit")).alias("exit"), "depth", F.expr("(n - n_exit - 1) div 2").alias("descendants"))
    )


def paths(tours: DataFrame, separator: str = "/") -> DataFrame:
    """Add ``way``, the ids from the root to the node, and ``path``, the same as one string.

    Jumps double as in :func:`peel`; each round prepends the ancestors that the jump skipped, so the
    work is the length of the paths and log2(depth) joins.
    """
    open_ = cut(tours.select("grp", "key", F.col("parent").alias("jump"), F.array("id").alias("way")))
    for _ in range(MAX_ROUNDS):
        if not open_.where("jump is not null").take(1):
            break
        ahead = open_.select("grp", F.col("key").alias("jump"), F.col("jump").alias("jump2"), F.col("way").alias("way2"))
        moved = open_.where("jump is not null").join(ahead, ["grp", "jump"]).select("grp", "key", F.col("jump2").alias("jump"), F.concat("way2", "way").alias("way"))
        open_ = cut(moved.unionByName(open_.where("jump is null")), open_)
    return tours.join(open_.select("grp", "key", "way", F.array_join("way", separator).alias("path")), ["grp", "key"])


def open_loops(nodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """Nodes as a forest: each loop is opened above its smallest id, which becomes a root."""
    heads = cycles.where("on_cycle and key = cycle_key").select("grp", "key", F.lit(True).alias("head"))
    return nodes.join(heads, ["grp", "key"], "left").withColumn("parent", F.when(F.col("head").isNull(), F.col("parent"))).drop("head")


def resolve_hierarchy(rows: DataFrame, elements: DataFrame | None = None, group: str = "fiche_id", node: str = "canonical_id", parent: str = "parent_id") -> DataFrame:
    """One row for each node: (group, node, parent, root, path, depth, entry, exit, descendants, cycle_id, implicit, way).

    cycle_id is null for nodes of a proper tree; nodes in or below a loop get the smallest id of the
    loop and are placed in the tree that opening the loop at that id gives. An empty table gives no
    rows; all other columns of ``rows`` are ignored.
    """
    nodes = cut(build_nodes(rows, elements, group, node, parent))
    cycles = peel(nodes)
    forest = cut(open_loops(nodes, cycles))
    done = paths(euler_tours(forest))
    names = nodes.select("grp", F.col("key").alias("root"), F.col("id").alias("root_id"))
    ups = nodes.select("grp", F.col("key").alias("parent"), F.col("id").alias("parent_id"))
    return (
        done.join(cycles.select("grp", "key", "cycle_id"), ["grp", "key"], "left")
        .join(names, ["grp", "root"])
        .join(ups, ["grp", "parent"], "left")
        .select(F.col("grp").alias(group), F.col("id").alias(node), F.col("parent_id").alias(parent), F.col("root_id").alias("root"), "path", "depth", "entry", "exit", "descendants", "cycle_id", "implicit", "way")
    )


def descendant_pairs(hierarchy: DataFrame, group: str = "fiche_id", node: str = "canonical_id") -> DataFrame:
    """(group, ancestor, descendant, distance): every pair, from the ids on the way to each node; linear in the result.

    Ids may hold any character: the way is an array, not the path's text.
    """
    return (
        hierarchy.select(group, F.col(node).alias("descendant"), F.col("depth"), F.posexplode("way"))
        .where("pos < depth")
        .select(group, F.col("col").alias("ancestor"), "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
    )
