"""Parent-child rows to full hierarchies.

Connected components are found first. Components of up to ``in_task`` nodes are
packed into partitions and walked one after the other, depth-first with an
explicit stack and node colours (white, grey, black); an edge to a grey node
closes a cycle, and paths leave the task in small batches. Components beyond
that bound never enter one task: their parent pointers, and the trails along
them, are doubled by joins until every chain has reached its root or its ring.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.components import connected_components
from cellweave.runtime import cut, width

_WALKED = "component bigint, node_id bigint, root_id bigint, depth int, path array<bigint>, back_edge boolean"
#: Path elements that are held before a batch leaves a task.
_BATCH = 500_000


def class_links(candidates: DataFrame) -> DataFrame:
    """``(node, parent)`` of the class records (no instances): one row each, parent null where none is named.

    Repeated fetches of an id are merged; null values and nulls inside
    ``subclasses`` are ignored. Of several distinct parents the smallest is used.
    """
    classes = candidates.where("id is not null and coalesce(size(instances), 0) <= 0")
    named = F.array_min(F.filter("subclasses", lambda x: x.isNotNull()))
    return classes.groupBy(F.col("id").alias("node")).agg(F.min(named).alias("parent"))


def walk(nodes: list[int], parents: list[int | None], paths: bool) -> Iterator[tuple]:
    """Depth-first over one component: ``(node, root, depth, path, back_edge)`` of every node given, one by one.

    A node whose chain never ends has depth -1, the smallest id of its ring as
    root and no path. ``back_edge`` marks the ring node whose parent link leads
    to that smallest id.
    """
    children: dict[int, list[int]] = {}
    parent_of = dict(zip(nodes, parents, strict=True))
    roots = dict.fromkeys(n if p is None else p for n, p in parent_of.items() if p is None or p not in parent_of)
    for node, parent in parent_of.items():
        if parent is not None:
            children.setdefault(parent, []).append(node)
    black: dict[int, int] = {}  # finished nodes and their roots
    for root in roots:
        stack = [iter(sorted(children.get(root, ())))]
        trail = [root]
        black[root] = root
        if root in parent_of:
            yield root, root, 0, [root] if paths else None, False
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                trail.pop()
                continue
            trail.append(child)
            black[child] = root
            yield child, root, len(trail) - 1, list(trail) if paths else None, False
            stack.append(iter(sorted(children.get(child, ()))))
    for start in nodes:
        if start in black:
            continue
        trail, grey, node = [], {}, start
        while node not in black and node not in grey:
            grey[node] = len(trail)
            trail.append(node)
            node = parent_of[node]
        closing = None
        if node in grey:  # met on this very trail: a ring
            ring = trail[grey[node] :]
            root = min(ring)
            closing = ring[ring.index(root) - 1]
        else:
            root = black[node]
        for x in trail:
            black[x] = root
            yield x, root, -1, None, x == closing


def _walk_components(paths: bool):
    """The components of one partition, whose rows come sorted by component."""

    def components(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        name, nodes, parents = None, [], []
        for pdf in batches:
            known = pdf["parent"].notna().tolist()
            for component, node, parent, there in zip(pdf["component"].tolist(), pdf["node"].tolist(), pdf["parent"].fillna(0).tolist(), known, strict=True):
                if component != name:
                    if nodes:
                        yield name, nodes, parents
                    name, nodes, parents = component, [], []
                nodes.append(node)
                parents.append(int(parent) if there else None)
        if nodes:
            yield name, nodes, parents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["component", "node_id", "root_id", "depth", "path", "back_edge"]
        rows, held = [], 0
        for component, nodes, parents in components(batches):
            for row in walk(nodes, parents, paths):
                rows.append((component, *row))
                held += 1 + len(row[3] or ())
                if held > _BATCH:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)

    return run


def double(links: DataFrame, paths: bool = True, max_rounds: int = 64) -> DataFrame:
    """``(node_id, root_id, depth, path, back_edge)`` of ``links(node, parent)`` by pointer doubling, with no bound on component size.

    Chains that have ended leave the join, so a root reached by a third of all
    nodes is no hot key. A chain that has not ended once its jump exceeds the
    number of nodes is on or above a ring; its last window covers the ring, and
    the nodes such chains stand at are the ring. A trail is the chain from where
    the pointer stands down to the node; it is let go once the chain is known to end in a ring.
    """
    total = links.count()
    heads = links.select(F.col("node").alias("head"))
    start = links.join(heads, F.col("parent") == F.col("head"), "left")
    up = F.coalesce("parent", "node")
    trail = F.when(F.col("parent").isNull(), F.array("node")).otherwise(F.array("parent", "node")) if paths else F.lit(None).cast("array<bigint>")
    current = cut(
        start.select(
            "node",
            up.alias("at"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
            F.least("node", up).alias("low"),
            F.col("head").isNull().alias("ended"),
            trail.alias("trail"),
        )
    )
    reach = 1
    for _ in range(max_rounds):
        running = current.where("not ended")
        if reach > total or running.isEmpty():
            break
        target = current.select(
            F.col("node").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("low").alias("low2"), F.col("ended").alias("end2"), F.col("trail").alias("above")
        )
        moved = running.join(target, "at").select(
            "node",
            F.col("next").alias("at"),
            (F.col("steps") + F.col("more")).alias("steps"),
            F.least("low", "low2").alias("low"),
            F.col("end2").alias("ended"),
            F.concat("above", F.slice("trail", F.lit(2), F.greatest(F.size("trail") - 1, F.lit(0)))).alias("trail"),
        )
        current = cut(current.where("ended").unionByName(moved))
        reach *= 2
    endless = current.where("not ended")
    ring = endless.select(F.col("node").alias("at"), F.col("low").alias("ring")).join(endless.select("at").distinct(), "at", "left_semi")
    named = current.join(ring, "at", "left").join(links.select("node", "parent"), "node").join(ring.select(F.col("at").alias("node"), F.lit(True).alias("on_ring")), "node", "left")
    root = F.when(F.col("ended"), F.col("at")).otherwise(F.col("ring"))
    return named.select(
        F.col("node").alias("node_id"),
        root.alias("root_id"),
        F.when(F.col("ended"), F.col("steps")).otherwise(-1).cast("int").alias("depth"),
        F.when(F.col("ended"), F.col("trail")).alias("path"),
        F.coalesce(F.col("on_ring") & (F.col("parent") == F.col("ring")), F.lit(False)).alias("back_edge"),
    )


def hierarchy(links: DataFrame, paths: bool = True, in_task: int = 200_000) -> DataFrame:
    """``(component, node_id, root_id, depth, path, back_edge)`` for every node of ``links(node, parent)``.

    ``depth`` counts the links to the root: the first id up the chain that names
    no parent or has no row of its own. Cycles give depth -1, the smallest id of
    the ring and no path; ``back_edge`` marks the link that closes a ring at its
    smallest id. Components larger than ``in_task`` give the same columns by
    doubling. An empty input gives no rows.
    """
    edges = links.select(F.col("node").alias("a"), F.coalesce("parent", "node").alias("b"))
    member = connected_components(edges).withColumnRenamed("node", "member")
    placed = cut(links.join(member, F.col("node") == F.col("member")).select("component", "node", "parent"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    giant = cut(sizes.where(F.col("n") > in_task).select("component"))
    any_giant = not giant.isEmpty()
    small = placed.join(giant, "component", "left_anti") if any_giant else placed
    packed = small.repartition(width(links.sparkSession), "component").sortWithinPartitions("component")
    walked = packed.mapInPandas(_walk_components(paths), _WALKED)
    if not any_giant:
        return walked
    rest = cut(placed.join(giant, "component", "left_semi"))
    far = double(rest.select("node", "parent"), paths).join(rest.select("component", F.col("node").alias("node_id")), "node_id")
    return walked.unionByName(far.select("component", "node_id", "root_id", "depth", "path", "back_edge"))


def descendants(walked: DataFrame) -> DataFrame:
    """``(ancestor, node_id, distance)``: every class below every class, from the paths."""
    below = walked.where("path is not null").select("node_id", "depth", F.posexplode("path").alias("pos", "ancestor"))
    return below.where("ancestor <> node_id").select("ancestor", "node_id", (F.col("depth") - F.col("pos")).alias("distance"))
