"""Cycles of a directed graph: strongly connected components, and the circuits inside each.

**Components.** Chains of nodes with one predecessor and one successor are replaced by one edge (pointers
double, so a chain of a million nodes takes twenty rounds), and edges that lead from or to an end are trimmed,
until neither helps. On what is left every node learns the smallest node that reaches it and the smallest
that it reaches; where both are the same node, that is its component, and edges between nodes that
differ in either cannot lie on a cycle. This repeats on the remaining edges. Nodes of chains follow from the
two ends of their chain.

**Circuits** lie inside components. Chains inside a component become one edge that carries its nodes, and
paths are then extended from the smallest node that is left, one join a step. The number of circuits
can be exponential in the size of a component; ``max_paths`` gives up on a component whose open
paths outgrow it, and the report says so for that component alone.

Every step is a join, an aggregate or a filter over tables written to the scratch folder; no node's
neighbours, chain or component is gathered, except that a circuit is an array of its nodes.

Self-loops and edges with a null end are ignored; parallel edges count once; no edges give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from auditframe.session import materialize, materialize_counted, materialize_measured


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _links(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def _trimmed(links: DataFrame) -> DataFrame:
    """Links whose source has a predecessor and whose target has a successor."""
    reached = links.select(F.col("dst").alias("src")).distinct()
    leading = links.select(F.col("src").alias("dst")).distinct()
    return links.join(reached, "src", "left_semi").join(leading, "dst", "left_semi").select("src", "dst")


def _chain_nodes(links: DataFrame) -> DataFrame:
    """Nodes with one predecessor and one successor: node, before, after."""
    ends = links.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(None).cast(links.schema["src"].dataType).alias("before"), F.col("dst").alias("after")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("before"), F.lit(None).cast(links.schema["src"].dataType).alias("after")))).alias("e")).select("e.*")
    grouped = ends.groupBy("node").agg(F.count("before").alias("ins"), F.count("after").alias("outs"), F.min("before").alias("before"), F.min("after").alias("after"))
    return grouped.where("ins = 1 and outs = 1").select("node", "before", "after")


def _chains(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each chain node with the last node of its chain; and the nodes of closed rings, with the smallest of the ring.

    (node, last, hops) and (node, least). A pointer doubles its reach each round, so what has not come to an
    end once it spans all nodes goes round.
    """
    known = nodes.select(F.col("node").alias("after"), F.lit(True).alias("goes_on"))
    at = nodes.join(known, "after", "left").select(
        "node", F.when(F.col("goes_on"), F.col("after")).otherwise(F.col("node")).alias("last"), F.when(F.col("goes_on"), 1).otherwise(0).cast("bigint").alias("hops"),
        F.col("goes_on").isNull().alias("ended"), F.when(F.col("goes_on"), F.least("node", "after")).otherwise(F.col("node")).alias("least"))
    at, seen = materialize_measured(at, "chains", size=F.count(F.lit(1)), open=F.count_if(~F.col("ended")))
    reach, size = 1, seen["size"]
    while seen["open"] and reach <= size:
        ahead = at.select(F.col("node").alias("last"), F.col("last").alias("next_last"), F.col("hops").alias("more"), F.col("ended").alias("next_ended"), F.col("least").alias("next_least"))
        moved = at.where("not ended").join(ahead, "last").select(
            "node", F.col("next_last").alias("last"), (F.col("hops") + F.col("more")).alias("hops"), F.col("next_ended").alias("ended"),
            F.least("least", "next_least").alias("least"))
        at, seen = materialize_measured(at.where("ended").unionByName(moved), "chains", open=F.count_if(~F.col("ended")))
        reach *= 2
    return at.where("ended").select("node", "last", "hops"), at.where("not ended").select("node", "least")


def _contracted(links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links with chains as one link; chain members (node, head, tail); ring members (node, least). ``nodes`` is a written table."""
    ended, rings = _chains(nodes)
    inner = nodes.select("node")
    first = nodes.join(inner.select(F.col("node").alias("before")), "before", "left_anti").join(ended, "node").select("last", F.col("before").alias("head"))
    spans = first.join(nodes.select(F.col("node").alias("last"), F.col("after").alias("tail")), "last")
    members = ended.join(spans, "last").select("node", "head", "tail")
    kept = links.join(inner.select(F.col("node").alias("src")), "src", "left_anti").join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
    short = spans.select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    return kept.select("src", "dst").unionByName(short.where(F.col("src") != F.col("dst"))).distinct(), members, rings


def least_labels(links: DataFrame) -> DataFrame:
    """For every node the smallest node that reaches it (f) and the smallest that it reaches (b)."""
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("f"), F.col("node").alias("b")), "labels")
    while True:
        forward = links.join(labels.select(F.col("node").alias("src"), "f"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("f").alias("f1"))
        backward = links.join(labels.select(F.col("node").alias("dst"), "b"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("b").alias("b1"))
        # What reaches the node that reaches this one reaches this one too.
        through = labels.select(F.col("node").alias("f"), F.col("f").alias("f2"))
        back_through = labels.select(F.col("node").alias("b"), F.col("b").alias("b2"))
        best = labels.join(forward, "node", "left").join(backward, "node", "left").join(through, "f").join(back_through, "b").select(
            "node", F.least("f", "f1", "f2").alias("f1"), F.least("b", "b1", "b2").alias("b1"), "f", "b")
        moved = F.col("f1").eqNullSafe(F.col("f")) & F.col("b1").eqNullSafe(F.col("b"))
        best, seen = materialize_measured(best.withColumn("same", moved), "labels", moved=F.count_if(~F.col("same")))
        labels = best.select("node", F.col("f1").alias("f"), F.col("b1").alias("b"))
        if not seen["moved"]:
            return labels


def _kernel_components(links: DataFrame, size: int) -> list[DataFrame]:
    """Components of a trimmed graph of ``size`` links, as tables (node, label)."""
    found = []
    while size:
        labels = least_labels(links)
        found.append(labels.where(F.col("f") == F.col("b")).select("node", F.col("f").alias("label")))
        rest = labels.where(F.col("f") != F.col("b"))
        pairs = links.join(rest.select(F.col("node").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1")), "src").join(
            rest.select(F.col("node").alias("dst"), "f", "b"), "dst")
        links, size = materialize_counted(_trimmed(pairs.where("f = f1 and b = b1").select("src", "dst")), "edges")
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component for the nodes that lie on a cycle; a component is named by its smallest node."""
    return _components(*materialize_counted(_links(edges), "edges"))


def _components(links: DataFrame, size: int) -> DataFrame:
    empty = links.select(F.col("src").alias("node"), F.col("src").alias("label")).limit(0)
    levels: list[DataFrame] = []
    labels = [empty]
    while True:
        links, left = materialize_counted(_trimmed(links), "edges")
        if left:
            inner, chained = materialize_counted(_chain_nodes(links), "inner")
            if chained:
                links, members, rings = _contracted(links, inner)
                levels.append(materialize(members, "members"))
                labels.append(materialize(rings.select("node", F.col("least").alias("label")), "rings"))
                links, left = materialize_counted(links, "edges")
        if left == size:
            break
        size = left
    known = materialize(_union([*labels, *_kernel_components(links, size)]), "components")
    for members in reversed(levels):
        heads = known.select(F.col("node").alias("head"), F.col("label").alias("h"))
        tails = known.select(F.col("node").alias("tail"), F.col("label").alias("t"))
        both = members.join(heads, "head", "left").join(tails, "tail", "left").select(
            "node", "head", F.coalesce("h", "head").alias("label"), F.coalesce("t", "tail").alias("t")).where("label = t")
        more = both.select("node", "label").unionByName(both.select(F.col("head").alias("node"), "label"))
        known = materialize(known.unionByName(more).distinct(), "components")
    sized = known.groupBy("label").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return known.join(sized, "label").select("node", "component")


def _without_chains(links: DataFrame, components: DataFrame) -> DataFrame:
    """The links inside components, chains as one edge: component, src, dst, via (the nodes passed)."""
    none = F.array().cast(ArrayType(links.schema["src"].dataType))
    # The smallest node of a component stays, so that a ring has an end.
    least = components.where("node = component").select("node")
    nodes, chained = materialize_counted(_chain_nodes(links.select("src", "dst")).join(least, "node", "left_anti"), "inner")
    if not chained:
        return links.withColumn("via", none)
    ended, _ = _chains(nodes)
    inner = nodes.select("node")
    first = nodes.join(inner.select(F.col("node").alias("before")), "before", "left_anti").join(ended.select("node", "last"), "node").select("last", F.col("before").alias("src"))
    passed = ended.groupBy("last").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("hops")).alias("place"), "node"))), lambda p: p["node"]).alias("via"))
    short = passed.join(first, "last").join(nodes.select(F.col("node").alias("last"), F.col("after").alias("dst")), "last").join(
        components.select(F.col("node").alias("src"), "component"), "src").select("component", "src", "dst", "via")
    kept = links.join(inner.select(F.col("node").alias("src")), "src", "left_anti").join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
    return materialize(kept.select("component", "src", "dst", none.alias("via")).unionByName(short), "inner-edges")


def cycle_search(edges: DataFrame, max_len: int | None = None, max_paths: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All circuits of two nodes or more, and a report on each component.

    Circuits: component, length, path, which begins at its smallest node. Report: component, nodes, edges, circuits,
    complete. A component is not complete if circuits over ``max_len`` nodes may exist, or if more than
    ``max_paths`` of its paths were open at once; its circuits that were found by then are listed.
    """
    links, size = materialize_counted(_links(edges), "edges")
    components = materialize(_components(links, size), "components")
    links = links.join(components.select(F.col("node").alias("src"), "component"), "src").join(
        components.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").where("component = other").select("component", "src", "dst")
    links = materialize(links, "inner-edges")
    inner = _without_chains(links, components)
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    columns = ["component", "start", "dst", "path"]

    def fits(size: Column) -> Column:
        return size <= max_len if max_len is not None else F.lit(True)

    path = F.concat(F.array("src"), "via")
    loops = inner.where(F.col("src") == F.col("dst")).select("component", F.col("src").alias("start"), "dst", path.alias("path"))
    opened = inner.where(F.col("src") < F.col("dst")).select("component", F.col("src").alias("start"), "dst", F.concat(path, F.array("dst")).alias("path"))
    step = materialize(loops.unionByName(opened), "paths")
    found, stopped = [], [components.select("component").limit(0)]
    while True:
        closed = F.col("dst") == F.col("start")
        found.append(step.where(closed & fits(F.size("path"))).select("component", "path"))
        long = step.where(~fits(F.size("path"))).select("component").distinct()
        if max_len is not None:
            stopped.append(long)
        alive = step.where(~closed & fits(F.size("path")))
        if max_paths is not None:
            crowded = materialize(alive.groupBy("component").count().where(F.col("count") > max_paths).select("component"), "crowded")
            stopped.append(crowded)
            alive = alive.join(crowded, "component", "left_anti")
        steps = alive.withColumnRenamed("dst", "last").join(inner.drop("component").withColumnRenamed("src", "last"), "last").where(F.col("dst") >= F.col("start"))
        steps = steps.where((F.col("dst") == F.col("start")) | ~F.array_contains("path", F.col("dst")))
        longer = F.concat("path", "via", F.when(F.col("dst") == F.col("start"), F.array().cast(step.schema["path"].dataType)).otherwise(F.array("dst")))
        step, rows = materialize_counted(steps.select("component", "start", "dst", longer.alias("path")).select(*columns), "paths")
        if not rows:
            break
    circuits = _union(found)
    place = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", place, F.size("path") - place + 1), F.slice("path", F.lit(1), place - 1))
    circuits = materialize(circuits.select("component", F.size("path").alias("length"), turned.alias("path")), "circuits")
    given_up = _union(stopped).distinct().withColumn("complete", F.lit(False))
    report = (
        sizes.join(links.groupBy("component").agg(F.count(F.lit(1)).alias("edges")), "component")
        .join(circuits.groupBy("component").agg(F.count(F.lit(1)).alias("circuits")), "component", "left")
        .join(given_up, "component", "left")
        .select("component", "nodes", "edges", F.coalesce("circuits", F.lit(0)).cast("bigint").alias("circuits"), F.coalesce("complete", F.lit(True)).alias("complete"))
    )
    return circuits, report
