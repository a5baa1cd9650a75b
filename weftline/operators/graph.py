"""Walks, ranks, components, cascades and overlays on a typed weighted graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.components import connected_components
from weftline.session import Scratch

# How much of a cascade each edge type passes on; others pass half.
KERNEL = {"INVOKES": 1.0, "SUPPORTS": 0.5, "LINKS": 0.7, "CONFLICTS": 0.0, "PARENT_OF": 0.8, "SEQUENCE": 0.6}
# Nodes that a budgeted walk takes of each edge type and hop, in order, and in all.
BUDGETS = (("INVOKES", 8), ("SEQUENCE", 10), ("SUPPORTS", 6), ("LINKS", 6), ("PARENT_OF", 4))
SUBSPACE_CAP = 60


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """Each edge from either end, as (src, dst, ...)."""
    return edges.select("src", "dst", *more).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more))


def transitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, p): undirected step probabilities; a weight of null or 0 counts as 1, a self-loop twice."""
    ends = nodes.select(F.col("id").alias("src"))
    weighed = edges.select("src", "dst", F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")).alias("w"))
    known = weighed.join(ends, "src", "left_semi").join(ends.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst", "w")
    summed = both_ways(known, "w").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    total = summed.groupBy("src").agg(F.sum("w").alias("total"))
    return summed.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p"))


def power_iteration(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6, stride: int = 5) -> DataFrame:
    """(id, score): PageRank, personalised where ``seeds(id)`` are given; without a valid seed all scores are 0.

    Nodes without edges spread their rank evenly. Every ``stride`` rounds the ranks are written to the
    scratch folder and the change of a round is compared with the tolerance.
    """
    scratch = Scratch(nodes.sparkSession)
    ids = nodes.select("id").distinct()
    if seeds is None:
        n = ids.count()
        base = ids.withColumn("t", F.lit(1.0 / max(n, 1)))
    else:
        inside = ids.join(seeds.select("id").distinct(), "id", "left_semi").withColumn("hit", F.lit(1.0))
        k, n = inside.count(), ids.count()
        base = ids.join(inside, "id", "left").select("id", (F.coalesce("hit", F.lit(0.0)) / max(k, 1)).alias("t"))
        if not k:
            return ids.withColumn("score", F.lit(0.0))
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    step = scratch.save(transitions(nodes, edges))
    base = scratch.save(base.join(step.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(True)), "id", "left"))
    rank = base.select("id", F.col("t").alias("r"))
    for done in range(1, rounds + 1):
        passed = rank.join(step, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("r") * F.col("p")).alias("inflow"))
        lost = rank.join(base.where("out IS NULL").select("id"), "id", "left_semi").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("lost"))
        new = base.join(passed, F.col("id") == F.col("dst"), "left").crossJoin(F.broadcast(lost))  # one row
        new = new.select("id", (damping * (F.coalesce("inflow", F.lit(0.0)) + F.col("lost") / n) + (1 - damping) * F.col("t")).alias("r"))
        if done % stride and done < rounds:
            rank = new
            continue
        new = scratch.save(new)
        if tolerance > 0 and done < rounds:
            before = rank.select("id", F.col("r").alias("old"))
            if (new.join(before, "id").agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] or 0) < tolerance:
                rank = new
                break
        rank = new
    return rank.select("id", F.col("r").alias("score"))


def peak_normalised(scores: DataFrame, column: str = "score") -> DataFrame:
    """Scores over their maximum; zeros if it is not positive."""
    top = scores.agg(F.max(column).alias("__top"))
    out = scores.crossJoin(F.broadcast(top))  # one row
    return out.withColumn(column, F.when(F.col("__top") > 0, F.col(column) / F.col("__top")).otherwise(0.0)).drop("__top")


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listed nodes and the edges with both ends among them."""
    own = ids.select("id").distinct()
    inside = edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(own, "id", "left_semi"), inside


def typed_walk(edges: DataFrame, seeds: DataFrame, types: list[str], hops: int = 2) -> DataFrame:
    """(id, hop, via_type, via_src): nodes reached over edges of some types; the least (type, src) discovers a node.

    A lazy plan of ``hops`` joins; visited nodes are left out by an anti join.
    """
    steps = both_ways(edges.where(F.col("type").isin(types)), "type")
    out = seeds.select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via_type"), F.lit(None).cast("string").alias("via_src")).distinct()
    front = out
    for hop in range(1, hops + 1):
        found = front.select(F.col("id").alias("src")).join(steps, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("type", "src")).alias("via"))
        front = found.join(out.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), F.col("via.type").alias("via_type"), F.col("via.src").alias("via_src"))
        out = out.unionByName(front)
    return out


def budgeted_subspace(nodes: DataFrame, edges: DataFrame, seeds: list[str], hops: int = 2, cap: int = SUBSPACE_CAP) -> list[tuple[str, int, str]]:
    """(id, hop, type) of a walk that takes, hop by hop and type by type, the strongest new slabs within budgets.

    Every list that meets the driver is bounded by the cap; each step filters the edges by it.
    """
    slabs = nodes.where("type = 'slab'").select("id")
    visited, front, out = set(seeds), list(seeds), []
    steps = both_ways(edges, "type", "weight")
    for hop in range(1, hops + 1):
        reached: list[str] = []
        for kind, budget in BUDGETS:
            if not front or len(out) >= cap:
                break
            near = steps.where((F.col("type") == kind) & F.col("src").isin(front) & ~F.col("dst").isin(sorted(visited)))
            best = near.groupBy(F.col("dst").alias("id")).agg(F.max("weight").alias("w")).join(slabs, "id", "left_semi")
            rows = best.orderBy(F.desc("w"), "id").limit(min(budget, cap - len(out))).collect()
            for r in rows:
                visited.add(r.id)
                reached.append(r.id)
                out.append((r.id, hop, kind))
        front = reached
    return out


def conflicts(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(id, partner): for CONFLICTS edges touching the set, each end outside with its partner, or both if both are inside."""
    own = inside.select("id").distinct().withColumn("in", F.lit(True))
    c = edges.where("type = 'CONFLICTS'").select("src", "dst")
    m = c.join(own.select(F.col("id").alias("src"), F.col("in").alias("si")), "src", "left").join(own.select(F.col("id").alias("dst"), F.col("in").alias("di")), "dst", "left").where("si OR di")
    both = F.array(
        F.when(F.col("di").isNotNull(), F.struct(F.col("src").alias("id"), F.col("dst").alias("partner"))), F.when(F.col("si").isNotNull(), F.struct(F.col("dst").alias("id"), F.col("src").alias("partner")))
    )
    return m.select(F.explode(F.array_compact(both)).alias("x")).select("x.*").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, size) of every node, nodes without edges alone."""
    comp = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), Scratch(nodes.sparkSession))
    out = nodes.select("id").join(comp, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))
    return out.join(out.groupBy("component").agg(F.count("*").alias("size")), "component").select("id", "component", "size")


def depths(nodes: DataFrame, needs: DataFrame, limit: int = 50) -> DataFrame:
    """(id, depth): 0 without dependencies inside the set, else one more than the deepest; cycles stop at the limit.

    ``needs(id, dep)``. A round of joins for each level, each written to the scratch folder.
    """
    scratch = Scratch(nodes.sparkSession)
    ids = nodes.select("id").distinct()
    needs = needs.join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("dep")), "dep", "left_semi").select("id", "dep")
    depth = scratch.save(ids.withColumn("depth", F.lit(0)))
    total = 0
    for _ in range(limit):
        deeper = needs.join(depth.select(F.col("id").alias("dep"), "depth"), "dep").groupBy("id").agg((F.max("depth") + 1).alias("d"))
        nxt = scratch.save(depth.join(deeper, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("depth")))
        now = nxt.agg(F.sum("depth")).first()[0] or 0
        scratch.drop(depth)
        depth = nxt
        if now == total:
            break
        total = now
    return depth


def label_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, community): weighted label propagation with a fixed tie order; nodes without edges are one community.

    The heaviest label of the neighbours wins, a node's own label breaking ties, then the smaller one.
    """
    scratch = Scratch(nodes.sparkSession)
    weighed = both_ways(edges.where("src <> dst").withColumn("w", F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))), "w")
    links = scratch.save(weighed.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    lonely = "~"
    ends = links.select(F.col("src").alias("id")).distinct().withColumn("on", F.lit(True))
    label = scratch.save(nodes.select("id").distinct().join(ends, "id", "left").select("id", F.when(F.col("on"), F.col("id")).otherwise(lonely).alias("community")))
    for _ in range(rounds):
        votes = links.join(label.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), F.col("community").alias("vote")).agg(F.sum("w").alias("w"))
        own = votes.join(label, "id").withColumn("own", (F.col("vote") == F.col("community")).cast("int"))
        best = own.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), (-F.col("own")).alias("o"), "vote")).alias("b")).select("id", F.col("b.vote").alias("new"))
        nxt = scratch.save(label.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community"), (F.coalesce("new", "community") != F.col("community")).alias("moved")))
        moved = nxt.where("moved").count()
        label = nxt.select("id", "community")
        if not moved:
            break
    return label


def coalesced(clusters: DataFrame, least: int = 3, name: str = "Misc") -> DataFrame:
    """Clusters of fewer than ``least`` members as one."""
    size = clusters.groupBy("community").agg(F.count("*").alias("n"))
    return clusters.join(size, "community").select("id", F.when(F.col("n") < least, F.lit(name)).otherwise(F.col("community")).alias("community"))


def cascade_strength(pairs: DataFrame, edges: DataFrame, fallback: float) -> DataFrame:
    """``pairs(src, dst)`` with ``strength``: weight, confidence and kernel of the edge, or the fallback without one."""
    kernel = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KERNEL.items() for x in kv]), F.col("type")), F.lit(0.5))
    one = edges.groupBy("src", "dst").agg(F.max_by(F.struct("type", "weight", "confidence"), F.struct("type", "weight")).alias("e")).select("src", "dst", "e.*")
    return pairs.join(one, ["src", "dst"], "left").select("src", "dst", F.coalesce(F.col("weight") * F.col("confidence") * kernel, F.lit(fallback)).alias("strength"))


def activated(start: DataFrame, edges: DataFrame, fallback: float = 0.5) -> DataFrame:
    """(id, weight): starting weights and what they pass along INVOKES edges, merged by the greatest."""
    pairs = edges.where("type = 'INVOKES'").select("src", "dst").distinct()
    passed = cascade_strength(pairs, edges, fallback).join(start.select(F.col("id").alias("src"), F.col("weight").alias("w")), "src").select(F.col("dst").alias("id"), (F.col("w") * F.col("strength")).alias("weight"))
    return start.select("id", "weight").unionByName(passed).groupBy("id").agg(F.max("weight").alias("weight"))


def reinforced(salience: DataFrame, edges: DataFrame) -> DataFrame:
    """Salience after SUPPORTS edges add source * weight * confidence * 0.5 * 0.1, 1 at most."""
    boost = edges.where("type = 'SUPPORTS'").join(salience.select(F.col("id").alias("src"), F.col("salience").alias("s")), "src")
    boost = boost.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("s") * F.col("weight") * F.col("confidence") * 0.05).alias("b"))
    return salience.join(boost, "id", "left").select("id", F.least(F.lit(1.0), F.col("salience") + F.coalesce("b", F.lit(0.0))).alias("salience"))


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (nodes, edges, digest) that changes with the set of ids: counts and an order-free digest of all ids."""
    n = nodes.agg(F.count("*").alias("nodes"), F.bit_xor(F.conv(F.substring(F.md5("id"), 1, 15), 16, 10).cast("long")).alias("digest"))
    return n.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges")))).select("nodes", "edges", "digest")  # one row each


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, missing): nodes without incoming, outgoing, or any edges."""
    ins = edges.select(F.col("dst").alias("id")).distinct().withColumn("i", F.lit(True))
    outs = edges.select(F.col("src").alias("id")).distinct().withColumn("o", F.lit(True))
    m = nodes.select("id").join(ins, "id", "left").join(outs, "id", "left")
    what = F.when(F.col("i").isNull() & F.col("o").isNull(), "both").when(F.col("i").isNull(), "in").when(F.col("o").isNull(), "out")
    return m.select("id", what.alias("missing")).where("missing IS NOT NULL")


def spine(edges: DataFrame) -> DataFrame:
    """(src, dst): the strongest SEQUENCE edge out of each node, ties to the smaller target."""
    best = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return edges.where("type = 'SEQUENCE'").withColumn("k", best).where("k = 1").select("src", "dst")


def orbit(children: DataFrame, slot: Column, of: Column, radius: float = 1.0) -> DataFrame:
    """Children with their place on a circle around the parent, by slot number and number of slots."""
    angle = 2 * F.pi() * slot / of
    return children.withColumn("x", radius * F.cos(angle)).withColumn("y", radius * F.sin(angle))


def new_edges(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposed (type, src, dst) that do not exist and are no self-loops, each once, with a deterministic id."""
    fresh = proposed.where("src <> dst").dropDuplicates(["type", "src", "dst"]).join(existing.select("type", "src", "dst"), ["type", "src", "dst"], "left_anti")
    return fresh.withColumn("id", F.concat_ws("_", F.lower("type"), "src", "dst"))
