"""Places for the nodes of a view. A view is capped (``LIMITS.viz_files``), so its boxes and rows are placed in one task; boxes of components are Spark aggregates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(nodes: DataFrame, labels: DataFrame, box_w: float, box_h: float) -> DataFrame:
    """nodes (node, x, y), labels (node, label) -> (node, x, y): components moved as blocks onto shelves, the whole centred on the origin.

    The tallest comes first, equally tall ones by label. A node without a label is a component of its own; a single component stays where it is.
    """
    own = nodes.select("node", "x", "y").join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    span = lambda c, box: (F.max(c) - F.min(c) + box)
    boxes = own.groupBy("label").agg((F.min("x") - box_w / 2).alias("x"), (F.min("y") - box_h / 2).alias("y"), span("x", box_w).alias("w"), span("y", box_h).alias("h"))
    gap = max(box_w, box_h) / 2

    def shelves(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["h", "label"], ascending=[False, True])
        full = max(b.w.iloc[0], 1.5 * math.sqrt(((b.w + gap) * (b.h + gap)).sum()))
        left, top, tall, moves = 0.0, 0.0, 0.0, []
        for x, y, w, h in zip(b.x, b.y, b.w, b.h, strict=True):
            if left and left + w > full:
                left, top, tall = 0.0, top + tall + gap, 0.0
            moves.append((left - x, top - y))
            left, tall = left + w + gap, max(tall, h)
        return b[["label"]].assign(dx=[m[0] for m in moves], dy=[m[1] for m in moves], n=len(b))

    kind = boxes.schema["label"].dataType.simpleString()
    moved = boxes.groupBy(F.lit(0).alias("view")).applyInPandas(shelves, f"label {kind}, dx double, dy double, n long")
    at = own.join(moved, "label").select("node", "n", F.when(F.col("n") > 1, F.col("x") + F.col("dx")).otherwise(F.col("x")).alias("x"), F.when(F.col("n") > 1, F.col("y") + F.col("dy")).otherwise(F.col("y")).alias("y"))
    middle = at.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))  # one row
    shift = lambda c, m: F.when(F.col("n") > 1, F.col(c) - F.col(m)).otherwise(F.col(c)).alias(c)
    return at.join(F.broadcast(middle)).select("node", shift("x", "mx"), shift("y", "my"))


def layered(nodes: DataFrame, edges: DataFrame, box_w: float, box_h: float, h_gap: float, v_gap: float, columns: int = 8, side: float = 60, top: float = 50) -> DataFrame:
    """nodes (node, tier, ord), edges (source, target) -> (node, x, y, width, height): a row for each tier, the highest on top.

    A row is ordered by the mean place of the neighbours in the row above, nodes without one last, ties by ``ord``; rows of more than ``columns`` nodes are wrapped.
    """

    def rows(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ends = pd.concat([links.rename(columns={"source": "node", "target": "other"}), links.rename(columns={"target": "node", "source": "other"})])
        above, tiers = {}, []
        for tier in sorted(own.tier.unique(), reverse=True):
            row = own[own.tier == tier].sort_values("ord")
            if above:
                place = ends.other.map(above)
                row = row.assign(mean=row.node.map(place.groupby(ends.node).mean()).fillna(math.inf)).sort_values("mean", kind="stable")
            above = {node: k for k, node in enumerate(row.node)}
            tiers.append(list(row.node))
        widest = min(columns, max(map(len, tiers), default=1))
        width = 2 * side + widest * box_w + (widest - 1) * h_gap
        out, y = [], top
        for tier in tiers:
            for at in range(0, len(tier), columns):
                line = tier[at : at + columns]
                x = (width - len(line) * box_w - (len(line) - 1) * h_gap) / 2
                out += [(node, x + k * (box_w + h_gap) + box_w / 2, y + box_h / 2) for k, node in enumerate(line)]
                y += box_h + v_gap
        return pd.DataFrame(out, columns=["node", "x", "y"]).assign(width=float(width), height=float(y - v_gap + top))

    kind = nodes.schema["node"].dataType.simpleString()
    one = F.lit(0).alias("view")
    both = nodes.select("node", "tier", "ord", one).groupBy("view").cogroup(edges.select("source", "target", one).groupBy("view"))
    return both.applyInPandas(lambda own, links: rows(own, links[["source", "target"]]), f"node {kind}, x double, y double, width double, height double")
