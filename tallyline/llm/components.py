"""Groups of like things from keys under which they meet, and connected components by alternating stars, as DataFrame
joins and groupings.

Each round links every node to the least node it sees, first over its larger neighbours, then over its
smaller ones, and writes the links to the shared folder; the number of rounds grows with the logarithm of
the longest path. Links stay in tables throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import released, shuffles_dropped, written


def _stars(edges: DataFrame) -> DataFrame:
    """One round: large star, then small star."""
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select("b", "m").where(F.col("b") != F.col("m")).toDF("a", "b")
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node of edges (two columns of one orderable type); component is its least node.

    Null ends and loops are ignored; no edges give no rows.
    """
    a, b = edges.columns
    table = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), name)
    mark = None
    while True:
        now = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == mark:
            break
        mark = (now["n"], now["h"])
        after = written(_stars(table), name)
        released(table)
        table = after
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).union(table.select("b", "b").distinct())


#: Parts of the keys that are looked through one after the other, so that their shuffles aren't on disk at once.
PARTS = 4


def met(keys: DataFrame) -> DataFrame:
    """(key, node) of the nodes that share a key with another; of keys with the same nodes the largest is enough.

    Keys are written once, in parts. A part is shuffled once, as it is: most keys have one node, so nothing is gained by counting
    before the shuffle, and the rows of shared keys are those that a key's count stands beside. A part goes when it is done.
    """
    parts = F.pmod("key", F.lit(PARTS)).cast("int").alias("part")
    table, found = written(keys.select("key", "node", parts), "keys", parts="part"), []
    shuffles_dropped(table)
    for part in range(PARTS):
        some = table.where(F.col("part") == part).select("key", "node")
        found.append(written(some.withColumn("m", F.count("*").over(W.partitionBy("key"))).where("m > 1"), "shared"))
        released(table, below=f"part={part}")
        shuffles_dropped(table)
    every = reduce(DataFrame.union, found)
    ends = [F.min("node").alias("x"), F.max("node").alias("y"), F.bit_xor(F.xxhash64("node")).alias("z")]
    largest = every.groupBy("key").agg(F.count("*").alias("m"), *ends).groupBy("m", "x", "y", "z").agg(F.max("key").alias("key"))
    out = written(every.join(largest.select("key"), "key", "left_semi").select("key", "node"), "met")
    released(table, *found)
    shuffles_dropped(out)
    return out


#: Parts of a key, and pairs that each row of two groups may bring; where there are more, the key is refined.
CROWD = 8
#: Pairs that each row of a refined key may bring, else it gets one more feature; and the features that it may have.
FEW, DEEP = 2, 8


def refined(features: DataFrame, roots: DataFrame, share: float) -> DataFrame:
    """Pairs (u, v) of nodes with different roots that have at least `share` of either's features in common.

    features: (node, space, f), f told apart by space; roots: (node, root). The rarest features come first; of n of them,
    two nodes with share * n in common have w in common among the first n - share * n + w. So keys are single features of
    that beginning, then, where a key is crowded, that key with each of the later ones, and so on: what many unlike nodes hold
    is never a key by itself. Keys of `DEEP` features aren't refined any more.
    """
    features = written(features.distinct(), "features")
    often = features.groupBy("f").agg(F.count("*").alias("often"))
    ranked = features.join(often, "f").groupBy("node", "space").agg(F.sort_array(F.collect_list(F.struct("often", "f"))).alias("fs"))
    shuffles_dropped(features)
    ranked = written(ranked.join(roots, "node").withColumn("n", F.size("fs")).withColumn("spare", (F.col("n") - F.ceil(F.lit(share) * F.col("n"))).cast("int")), "ranked")
    rows = ranked.select("node", "space", "root", F.expr("inline(transform(slice(fs, 1, spare + 1), (x, i) -> struct(x.f as key, x.often as often, i as at)))")).where("often > 1").drop("often")
    found, used = [], [features]
    for width in range(1, DEEP + 1):
        rows = written(rows, "refined")
        used.append(rows)
        held = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("alike"))
        held = held.where("n * n > alike").withColumn("crowded", (F.col("n") * F.col("n") - F.col("alike")) / 2 > FEW * F.col("n"))
        held = written(held, "refined-keys")
        used.append(held)
        few = rows.join((held if width == DEEP else held.where("not crowded")).select("key"), "key", "left_semi").select("key", "node", "root")
        pairs = few.toDF("key", "u", "x").join(few.toDF("key", "v", "y"), "key").where("x <> y and u < v").select("u", "v").distinct()
        found.append(written(pairs, "refined-pairs"))
        shuffles_dropped(ranked)
        many = held.where("crowded").select("key")
        if width == DEEP or many.isEmpty():
            break
        more = rows.join(many, "key", "left_semi").join(ranked.select("node", "space", "fs", "spare"), ["node", "space"])
        later = f"inline(transform(slice(fs, at + 2, greatest(spare + {width + 1} - at - 1, 0)), (x, i) -> struct(xxhash64(key, x.f) as key2, x.often as often, at + 1 + i as at2)))"
        rows = more.select("node", "space", "root", "key", "at", "fs", "spare").select("node", "space", "root", F.expr(later)).where("often > 1")
        rows = rows.select("node", "space", "root", F.col("key2").alias("key"), F.col("at2").alias("at"))
    out = written(reduce(DataFrame.union, found).distinct(), "refined-pairs")
    released(ranked, *used, *found)
    shuffles_dropped(out)
    return out


#: Pairs that one task should get of a key, or of two groups, that all pairs are looked at of.
DEALT = 1_000_000


def unsettled(rest: DataFrame, crowded: DataFrame, many: DataFrame, joined: DataFrame, limited: Callable[[DataFrame], DataFrame], allowed: Callable[[Column], Column], carried: Callable[[DataFrame], DataFrame], distance: Callable[[Column], Column]) -> DataFrame | None:
    """Links (u, v) between components that meet in a crowded key, or in two large groups: all pairs, less what bounds rule out.

    rest: (key, node, size, chief, d), crowded: (key), many: (key, chief_u, chief_v), joined: (node, component). First the
    chiefs of crowded keys, then the nodes near chiefs that don't settle it. Pairs are dealt out, so no task has all of a
    key, and their distance is taken where they are made: only near ones leave the join. Their number grows with the square of
    such a key's unlike nodes, the memory doesn't.
    """
    now = rest.join(crowded.union(many.select("key")).distinct(), "key", "left_semi").join(joined, "node", "left")
    now = written(now.select("key", "node", "size", "chief", "d", F.coalesce("component", "node").alias("root")), "unsettled")
    apart = now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    now = now.join(apart, "key", "left_semi")
    if now.isEmpty():
        return None
    marks = written(carried(now.select("node").union(now.select("chief")).distinct()), "carried")
    shuffles_dropped(marks)

    def dealt(left: DataFrame, right: DataFrame, on: list[str], node: str) -> DataFrame:
        """left and right, which have a column `slices`, joined; other columns get u_ and v_."""
        named = lambda rows, x: rows.select(*on, "slice", *(F.col(c).alias(f"{x}_{c}") for c in rows.columns if c not in (*on, "slice", "slices")))
        left = left.join(marks.withColumnRenamed("node", node), node).withColumn("slice", F.pmod(F.xxhash64(node), F.col("slices")))
        right = right.join(marks.withColumnRenamed("node", node), node).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        return named(left, "u").join(named(right, "v"), [*on, "slice"])

    parts = now.join(crowded, "key", "left_semi").groupBy("key", "chief", "root").agg(F.max("d").alias("d"), F.max("size").alias("high"), F.min("size").alias("low"))
    slices = parts.groupBy("key").agg(F.ceil(F.count("*") * F.count("*") / DEALT).alias("slices"))
    parts = written(parts.join(slices, "key"), "parts")
    most = allowed(F.greatest("u_high", "v_high"))
    limit = most + F.col("u_d") + F.col("v_d")
    far = (F.col("u_low") - F.col("v_high") > most) | (F.col("v_low") - F.col("u_high") > most)
    both = dealt(parts, parts, ["key"], "chief").where((F.col("u_chief") < F.col("v_chief")) & (F.col("u_root") != F.col("v_root")) & ~far)
    both = both.select(F.col("u_chief").alias("u"), F.col("v_chief").alias("v"), distance(limit).alias("d")).where("d is not null")
    found = written(both.distinct(), "chiefs")
    shuffles_dropped(found)
    links = written(limited(found.select("u", "v")).join(found, ["u", "v"]).where("d <= limit").select("u", "v"), "links")

    held = now.groupBy("key", "chief").agg(F.count("*").alias("n"))
    open_ = parts.select("key").distinct().join(held, "key").select("key", F.col("chief").alias("chief_u")).join(found.select(F.col("u").alias("chief_u"), F.col("v").alias("chief_v")), "chief_u")
    meets = many.select("key", "chief_u", "chief_v").union(open_.select("key", "chief_u", "chief_v")).distinct()
    meets = meets.join(held.toDF("key", "chief_u", "n_u"), ["key", "chief_u"]).join(held.toDF("key", "chief_v", "n_v"), ["key", "chief_v"]).where("n_u * n_v > 1")
    meets = written(meets.select("key", "chief_u", "chief_v", F.ceil(F.col("n_u") * F.col("n_v") / DEALT).alias("slices")), "meets")
    sides = [now.select("key", F.col("chief").alias(f"chief_{x}"), "node", "size", "root").join(meets, ["key", f"chief_{x}"]) for x in "uv"]
    most = allowed(F.greatest("u_size", "v_size"))
    single = dealt(*sides, ["key", "chief_u", "chief_v"], "node").where((F.col("u_root") != F.col("v_root")) & (F.abs(F.col("u_size") - F.col("v_size")) <= most))
    full = single.where(distance(most).isNotNull()).select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).distinct()
    out = written(links.union(full), "more-links")
    released(marks, parts, found, links, meets)
    shuffles_dropped(out)
    return out


def grouped(keyed: DataFrame, sizes: DataFrame, compared: Callable[[DataFrame], DataFrame], allowed: Callable[[Column], Column], features: Callable[[DataFrame], DataFrame] | None = None, share: float = 0.75, carried: Callable[[DataFrame], DataFrame] | None = None, distance: Callable[[Column], Column] | None = None) -> DataFrame:
    """(node, component) of the nodes that links reach; keyed: distinct (key, node), sizes: (node, size).

    compared takes pairs (u, v, limit) and returns (u, v, d, least): d, a bound from above of their distance, if it is
    found to be `limit` at most, else null; least: a bound from below. A distance is a metric; u and v are linked at a
    distance of allowed(the larger size) at most. features takes (node) and returns (node, space, f) for `refined`.

    1. Each node is compared with one chief, the least first node of its keys.
    2. Of keys whose nodes aren't all in one component by now, the chiefs are compared. If theirs is so far that no node
       near the one can be linked with a node near the other, by the triangle inequality, that settles all their nodes.
    3. What is left is compared pairwise.
    4. With features, negative keys of more than `CROWD` parts, and groups between which step 3 would make more than `CROWD`
       pairs a node, go to `refined` first: a key that many unlike nodes share says too little. That finds the pairs that
       have `share` of their features in common. If links don't imply that, step 5 is needed.
    5. With carried, of keys and groups of step 4 whose nodes aren't all in one component by then, all other pairs are
       looked at, as in steps 2 and 3. carried takes (node) and returns (node, other columns), which the sides of a pair
       have as u_ and v_; distance takes the limit and returns the distance by these, null beyond the limit. So no pair of a
       key is missed.
    """
    chiefs = keyed.groupBy("key").agg(F.min("node").alias("chief"))
    pairs = keyed.join(chiefs, "key").where("node <> chief").groupBy(F.col("node").alias("v")).agg(F.min("chief").alias("u"))

    def limited(some: DataFrame) -> DataFrame:
        """Pairs (u, v) with what their sizes allow."""
        some = some.join(sizes.toDF("u", "size_u"), "u").join(sizes.toDF("v", "size_v"), "v")
        most = allowed(F.greatest("size_u", "size_v"))
        return some.where(F.abs(F.col("size_u") - F.col("size_v")) <= most).select("u", "v", most.alias("limit"))

    near = written(compared(limited(pairs.select("u", "v"))).where("d is not null").select("u", "v", "d"), "links")
    shuffles_dropped(near)
    so_far = written(components(near.select("u", "v")), "groups")
    own = near.select(F.col("v").alias("node"), F.col("u").alias("chief"), "d")
    members = keyed.join(so_far, "node", "left").join(own, "node", "left").join(sizes, "node")
    members = members.select("key", "node", "size", F.coalesce("component", "node").alias("root"), F.coalesce("chief", "node").alias("chief"), F.coalesce("d", F.lit(0)).alias("d"))
    members = written(members, "members")
    apart = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    rest = written(members.join(apart, "key", "left_semi"), "rest")
    parts = rest.groupBy("key", "chief", "root").agg(F.max("d").alias("d"), F.max("size").alias("high"), F.min("size").alias("low"))
    parts = written(parts, "parts")
    released(members)
    shuffles_dropped(parts)
    few = parts
    if features:
        crowded = written(parts.groupBy("key").agg(F.count("*").alias("m")).where(f"m > {CROWD} and key < 0").select("key"), "crowded")
        few = parts.join(crowded, "key", "left_anti")
    left, right = few.toDF("key", "u", "root_u", "d_u", "high_u", "low_u"), few.toDF("key", "v", "root_v", "d_v", "high_v", "low_v")
    most = allowed(F.greatest("high_u", "high_v"))
    far = (F.col("low_u") - F.col("high_v") > most) | (F.col("low_v") - F.col("high_u") > most)
    both = left.join(right, "key").where((F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & ~far)
    both = both.groupBy("u", "v").agg(F.max(most + F.col("d_u") + F.col("d_v")).alias("limit"))
    both = written(both, "both")
    shuffles_dropped(both)
    found = compared(both.select("u", "v", "limit")).where("d is not null").select("u", "v", "d")
    found = written(found, "chiefs")
    released(both)
    shuffles_dropped(found)
    # A chief pair within its own sizes' allowance is a link; the others only bound.
    links = limited(found.select("u", "v")).join(found, ["u", "v"]).where("d <= limit").select("u", "v")
    open_ = found.select(F.col("u").alias("chief_u"), F.col("v").alias("chief_v"))
    merged = written(components(near.select("u", "v").union(links)), "groups")
    now = rest.drop("root", "size", "d").join(merged, "node", "left").select("key", "node", "chief", F.coalesce("component", "node").alias("root"))
    hard = None
    if features:
        settled = now.join(crowded, "key", "left_anti")
        held = settled.groupBy("key", "chief").agg(F.count("*").alias("n"))
        meets = held.toDF("key", "chief_u", "n_u").join(open_, "chief_u").join(held.toDF("key", "chief_v", "n_v"), ["key", "chief_v"])
        meets = written(meets.select("key", "chief_u", "chief_v", F.expr(f"key < 0 and n_u * n_v > {CROWD} * (n_u + n_v)").alias("many")), "meets")
        large = meets.where("many").select("key", F.explode(F.array("chief_u", "chief_v")).alias("chief")).distinct()
        hard = now.join(crowded, "key", "left_semi").select("node", "root").union(settled.join(large, ["key", "chief"], "left_semi").select("node", "root"))
        hard = written(hard.distinct(), "hard")
        one = now.toDF("key", "u", "chief_u", "root_u").join(meets.where("not many").select("key", "chief_u", "chief_v"), ["key", "chief_u"])
    else:
        one = now.toDF("key", "u", "chief_u", "root_u").join(open_, "chief_u")
    two = now.toDF("key", "v", "chief_v", "root_v")
    single = one.join(two, ["key", "chief_v"]).where(F.col("root_u") != F.col("root_v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    if features and not hard.isEmpty():
        single = single.union(refined(features(hard.select("node")), hard, share)).distinct()
    single = written(single, "single")
    shuffles_dropped(single)
    full = written(compared(limited(single)).where("d is not null").select("u", "v"), "more-links")
    released(single)
    shuffles_dropped(full)
    out = merged if full.isEmpty() else components(merged.select("node", "component").union(full))
    if features and carried:
        out = written(out, "groups")
        more = unsettled(rest.drop("root"), crowded, meets.where("many").drop("many"), out, limited, allowed, carried, distance)
        if more is not None and not more.isEmpty():
            out = components(out.select("node", "component").union(more))
    released(near, so_far, rest, parts, found)
    if features:
        released(crowded, meets, hard)
    shuffles_dropped(keyed)
    return out
