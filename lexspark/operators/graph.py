"""Sense-graph queries on tables: sense, edge(src, dst, label, ord), form_sense(form, sense, ord).

Depths and ancestor paths come from one walk down from the root, level by level; shortest paths from frontier joins for
all pairs at once and from both ends, solved pairs leaving the frontier. Every level is cut, so plans stay short on deep graphs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.session import cut, release

#: Fixed value: the sense every other one descends from.
ROOT = "PRIM..1"


@dataclass(frozen=True)
class SenseGraph:
    """The tables of a graph. `edge` goes from a sense to its descriptor, labelled primary or secondary; a later edge
    between the same two senses replaces the earlier one. Ends of edges count as senses even without an entry."""

    edge: DataFrame
    form_sense: DataFrame
    sense: DataFrame | None = None

    def edges(self) -> DataFrame:
        last = self.edge.groupBy("src", "dst").agg(F.max_by("label", "ord").alias("label"), F.min("ord").alias("ord"))
        return last.filter("src IS NOT NULL AND dst IS NOT NULL")

    def senses(self) -> DataFrame:
        e = self.edges()
        ids = e.select(F.col("src").alias("sense")).union(e.select(F.col("dst").alias("sense")))
        return (ids.union(self.sense.select("sense")) if self.sense is not None else ids).distinct()

    def descriptor(self, label: str = "primary") -> DataFrame:
        """(sense, parent): the first edge with the label."""
        return self.edges().filter(F.col("label") == label).groupBy(F.col("src").alias("sense")).agg(F.min_by("dst", F.struct("ord", "dst")).alias("parent"))

    def children(self) -> DataFrame:
        """(sense, child) along primary edges."""
        return self.edges().filter("label = 'primary'").select(F.col("dst").alias("sense"), F.col("src").alias("child"))

    def lookup(self, forms: DataFrame, form: str = "form") -> DataFrame:
        """forms with their senses (`sense`, `ord`), case-sensitively; forms without one are left out."""
        return forms.join(self.form_sense.select(F.col("form").alias("_f"), "sense", "ord"), F.col(form) == F.col("_f")).drop("_f")


def depths(graph: SenseGraph, root: str = ROOT) -> DataFrame:
    """(sense, depth, path): path from the root to the sense along first primary edges. Senses that do not lead to the
    root, cycles among them, have no row. Levels are walked until one is empty; a sense has one parent, so none comes
    twice and the walk ends."""
    parents = cut(graph.descriptor().filter(F.col("sense") != root), "parents")
    out = level = cut(graph.senses().filter(F.col("sense") == root).select("sense", F.lit(0).alias("depth"), F.array("sense").alias("path")), "level")
    for d in count(1):
        level = cut(parents.join(level.select(F.col("sense").alias("parent"), "path"), "parent").select("sense", F.lit(d).alias("depth"), F.concat("path", F.array("sense")).alias("path")), "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def ancestors(paths: DataFrame) -> DataFrame:
    """(sense, ancestor, hops, ancestor_depth), the sense itself at 0 hops."""
    return paths.select("sense", "depth", F.posexplode("path").alias("ancestor_depth", "ancestor")).select("sense", "ancestor", (F.col("depth") - F.col("ancestor_depth")).alias("hops"), "ancestor_depth")


def wu_palmer(pairs: DataFrame, paths: DataFrame, s1: str = "s1", s2: str = "s2") -> DataFrame:
    """Distinct (s1, s2) with wu_palmer = 2 depth(lcs) / (depth(s1) + depth(s2)); 1 for a sense with itself; null if a
    sense has no depth. The lcs is the first ancestor of s1, itself included, that is also one of s2: two paths from
    the same root part where the lcs ends."""
    p1, p2 = paths.select(F.col("sense").alias("_1"), F.col("path").alias("_p1")), paths.select(F.col("sense").alias("_2"), F.col("path").alias("_p2"))
    j = pairs.select(s1, s2).distinct().join(p1, F.col(s1) == F.col("_1"), "left").join(p2, F.col(s2) == F.col("_2"), "left")
    common = F.size(F.filter(F.zip_with("_p1", "_p2", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    total = F.size("_p1") + F.size("_p2") - 2
    known = F.col("_p1").isNotNull() & F.col("_p2").isNotNull()
    return j.select(s1, s2, F.when(known & (F.col(s1) == F.col(s2)), 1.0).when(known, 2.0 * (common - 1) / F.when(total > 0, total)).alias("wu_palmer"))


def path_lengths(pairs: DataFrame, graph: SenseGraph, s1: str = "s1", s2: str = "s2", max_hops: int | None = None) -> DataFrame:
    """Distinct (s1, s2) with path_length over all edges in either direction: 0 for a known sense with itself, null if
    unreachable (within max_hops, if given) or unknown.

    Frontiers of all open pairs advance together from both ends, the side with fewer nodes next: a shortest path of
    a + b hops has a node a hops from the one end and b from the other. A pair leaves when its frontiers meet or one of
    them has no node left. Edges go both ways, so new nodes are those that the last two frontiers do not hold."""
    e = graph.edges()
    both = cut(e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select("dst", "src")).distinct(), "edges")
    want = cut(pairs.select(F.col(s1).alias("s1"), F.col(s2).alias("s2")).filter("s1 IS NOT NULL AND s2 IS NOT NULL").distinct(), "want")
    known = graph.senses()
    start = [cut(want.select(F.col(s).alias("source")).distinct().join(known.select(F.col("sense").alias("source")), "source", "left_semi").select("source", F.col("source").alias("node")), "frontier") for s in ("s1", "s2")]
    last, size, found, open_, hops = [[start[0]], [start[1]]], [f.count() for f in start], [], want, 0
    while True:
        near, far = last[0][-1].withColumnRenamed("source", "s1"), last[1][-1].withColumnRenamed("source", "s2")
        met = open_.join(near, "s1").join(far, ["s2", "node"]).groupBy("s1", "s2").agg(F.lit(True).alias("met"))
        going = near.select("s1").distinct().withColumn("_n", F.lit(True)), far.select("s2").distinct().withColumn("_f", F.lit(True))
        state = open_.join(met, ["s1", "s2"], "left").join(going[0], "s1", "left").join(going[1], "s2", "left")
        state = cut(state.filter(F.col("met") | (F.col("_n") & F.col("_f"))).select("s1", "s2", F.coalesce("met", F.lit(False)).alias("met")), "state")
        found.append(state.filter("met").select("s1", "s2", F.lit(hops).alias("path_length")))
        open_ = state.filter("NOT met").select("s1", "s2")
        if (max_hops is not None and hops >= max_hops) or open_.isEmpty():
            break
        i = 0 if size[0] <= size[1] else 1
        live = last[i][-1].join(open_.select(F.col(("s1", "s2")[i]).alias("source")).distinct(), "source", "left_semi")
        step = live.join(both, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), F.lit(False).alias("old"))
        for f in last[i][-2:]:
            step = step.unionByName(f.withColumn("old", F.lit(True)))
        step = cut(step.groupBy("source", "node").agg(F.max("old").alias("old")).filter("NOT old").select("source", "node"), "frontier")
        if len(last[i]) > 1:
            release(last[i][0])
        last[i] = [last[i][-1], step]
        size[i] = step.count()
        hops += 1
    release(*last[0], *last[1], both)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return want.join(out, ["s1", "s2"], "left").select(F.col("s1").alias(s1), F.col("s2").alias(s2), "path_length")


def sense_pairs(pairs: DataFrame, graph: SenseGraph, target: str = "target", response: str = "response") -> DataFrame:
    """Distinct (target, response) with every pair of their senses; s1 or s2 null where a word has none."""
    f = graph.form_sense
    t, r = f.select(F.col("form").alias("_t"), F.col("sense").alias("s1")), f.select(F.col("form").alias("_r"), F.col("sense").alias("s2"))
    return pairs.select(target, response).distinct().join(t, F.col(target) == F.col("_t"), "left").join(r, F.col(response) == F.col("_r"), "left").drop("_t", "_r")


def pair_similarity(pairs: DataFrame, graph: SenseGraph, paths: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(target, response, path_similarity, wu_palmer): the greatest 1 / (1 + path) and Wu-Palmer over sense pairs; null
    where there is none."""
    senses = cut(sense_pairs(pairs, graph), "senses")
    some = senses.filter("s1 IS NOT NULL AND s2 IS NOT NULL")
    pl = path_lengths(some, graph, max_hops=max_hops)
    wp = wu_palmer(some, paths if paths is not None else depths(graph))
    j = senses.join(pl, ["s1", "s2"], "left").join(wp, ["s1", "s2"], "left")
    return j.groupBy("target", "response").agg(F.max(1.0 / (1 + F.col("path_length"))).alias("path_similarity"), F.max("wu_palmer").alias("wu_palmer"))


def relation_summary(pairs: DataFrame, graph: SenseGraph, max_hops: int = 3, use_descriptors: bool = False) -> DataFrame:
    """(target, response, relation): oov(both), oov(t), oov(r), mother(t→r), m-sibling, near or far by the shortest
    path between their senses (1, 2, up to max_hops; 0 is near). `use_descriptors` first asks who is whose primary
    descriptor, which also tells mother(r→t)."""
    senses = cut(sense_pairs(pairs, graph), "senses")
    some = senses.filter("s1 IS NOT NULL AND s2 IS NOT NULL")
    j = senses.join(path_lengths(some, graph, max_hops=max_hops), ["s1", "s2"], "left")
    if use_descriptors:
        d = graph.descriptor()
        j = j.join(d.select(F.col("sense").alias("s1"), F.col("parent").alias("p1")), "s1", "left").join(d.select(F.col("sense").alias("s2"), F.col("parent").alias("p2")), "s2", "left")
        flags = [F.bool_or(F.coalesce(c, F.lit(False))) for c in (F.col("p1") == F.col("s2"), F.col("p2") == F.col("s1"), F.col("p1") == F.col("p2"))]
    else:
        flags = [F.lit(False)] * 3
    best = F.min("path_length")
    g = j.groupBy("target", "response").agg(best.alias("best"), F.bool_or(F.col("s1").isNotNull()).alias("t"), F.bool_or(F.col("s2").isNotNull()).alias("r"), *[f.alias(f"f{i}") for i, f in enumerate(flags)])
    b = F.col("best")
    label: Column = (
        F.when(~F.col("t") & ~F.col("r"), "oov(both)").when(~F.col("t"), "oov(t)").when(~F.col("r"), "oov(r)").when(F.col("f0"), "mother(t→r)").when(F.col("f1"), "mother(r→t)").when(F.col("f2"), "m-sibling")
        .when(b == 1, "mother(t→r)").when(b == 2, "m-sibling").when(b <= max_hops, "near").otherwise("far")
    )
    return g.select("target", "response", label.alias("relation"))


def graph_stats(graph: SenseGraph, paths: DataFrame) -> DataFrame:
    """One row: n_senses, n_primary, n_secondary, n_connected, max_depth."""
    e = graph.edges().agg(F.count_if(F.col("label") == "primary").alias("n_primary"), F.count_if(F.col("label") == "secondary").alias("n_secondary"))
    s, p = graph.senses().agg(F.count("*").alias("n_senses")), paths.agg(F.count("*").alias("n_connected"), F.max("depth").alias("max_depth"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(s).join(one(e), "_k").join(one(p), "_k").drop("_k")


def depth_histogram(paths: DataFrame) -> DataFrame:
    """depth, n: how many senses lie how far below the root."""
    return paths.groupBy("depth").agg(F.count("*").alias("n"))


def best_sense(pairs: DataFrame, graph: SenseGraph, paths: DataFrame | None = None) -> DataFrame:
    """(target, response, s1, s2, wu_palmer): the pair of senses of each word pair with the greatest similarity, the
    least ids if equal; word pairs without a similarity are left out."""
    senses = cut(sense_pairs(pairs, graph).filter("s1 IS NOT NULL AND s2 IS NOT NULL"), "senses")
    wp = wu_palmer(senses, paths if paths is not None else depths(graph)).filter("wu_palmer IS NOT NULL")
    best = senses.join(wp, ["s1", "s2"]).groupBy("target", "response").agg(F.min(F.struct((-F.col("wu_palmer")).alias("m"), "s1", "s2")).alias("b"))
    return best.select("target", "response", "b.s1", "b.s2", (-F.col("b.m")).alias("wu_palmer"))


def check_graph(stats: DataFrame, n_senses: int | None = None, least_primary: int | None = None, secondary: tuple[int, int] | None = None, max_depth: tuple[int, int] | None = None) -> list[str]:
    """What in the statistics of a graph is not as expected; empty if all is."""
    r = stats.first()
    wrong = []
    if n_senses is not None and r["n_senses"] != n_senses:
        wrong.append(f"{r['n_senses']} senses, expected {n_senses}")
    if least_primary is not None and r["n_primary"] < least_primary:
        wrong.append(f"{r['n_primary']} primary edges, expected at least {least_primary}")
    for name, bounds in (("n_secondary", secondary), ("max_depth", max_depth)):
        if bounds is not None and not bounds[0] <= (r[name] or 0) <= bounds[1]:
            wrong.append(f"{name} is {r[name]}, expected {bounds[0]} to {bounds[1]}")
    return wrong
