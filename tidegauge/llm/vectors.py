"""Near-duplicate vectors by int8 tile products with rigorous error bounds (operator 4).

Vectors of a label that are the same are one class. Classes are dealt into cells by their angle to a fixed axis; two
vectors whose cosine reaches the threshold differ by at most its angle there, so that only equal and adjacent cells can
hold a pair. Cells are cut into blocks of bounded size, and each pair of blocks is a tile: one task's bounded work.
In a tile every unit vector a is written as s*q with q of int8 and an error e = |a - s*q|. The product of the int8
parts, exact in float32 arithmetic, then bounds the cosine from above by s*t*(q.r) + e*|t*r| + f, and only pairs
whose bound reaches the threshold are computed in double precision. A tile returns the number of links of each of its
vectors and the edges of a spanning forest, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing
(n_links 0, component their own id, kept); vectors of unequal length never link; equal vectors link; rows that share a
vec_id each count, and keep the same component; a null vec_id stays null and is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage
from .components import components


def _forest(n: int):
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find


def tile_links(left: np.ndarray, right: np.ndarray | None, threshold: float) -> list[tuple[int, np.ndarray]]:
    """(i, indices j) of the pairs of unit rows with cosine >= threshold; within ``left`` (i < j) if right is None."""

    def quantise(x: np.ndarray):
        scale = np.abs(x).max(1) / 127.0
        q = np.rint(x / scale[:, None]).astype(np.int8)
        error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(1)) + 1e-12
        length = np.sqrt((q.astype(np.float64) ** 2).sum(1)) * scale
        return q.astype(np.float32), scale, error, length

    q, s, e, _ = quantise(left)
    r, t, f, tr = quantise(left if right is None else right)
    other, out = left if right is None else right, []
    for at in range(0, len(left), 512):
        rows = slice(at, at + 512)
        exact = (q[rows] @ r.T).astype(np.float64) if left.shape[1] * 127 * 127 < 1 << 24 else q[rows].astype(np.float64) @ r.T.astype(np.float64)
        bound = exact * s[rows, None] * t[None, :] + e[rows, None] * tr[None, :] + f[None, :] + 1e-9
        for i, row in enumerate(bound >= threshold, at):
            js = np.flatnonzero(row[i + 1 :]) + i + 1 if right is None else np.flatnonzero(row)
            if len(js):
                js = js[other[js] @ left[i] >= threshold]
                if len(js):
                    out.append((i, js))
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("x") > 0) & finite, F.lit(False))
    rows = rows.withColumn("usable", usable).withColumn("x", F.transform("x", lambda v: v + F.lit(0.0)))
    good = rows.where(F.col("usable") & F.col("vec_id").isNotNull())
    classes = stage(good.groupBy("label", "x").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies")), "classes")
    step = math.acos(threshold)
    # the axis is all ones; norms are scaled by the largest component, so nothing overflows
    biggest = F.array_max(F.transform("x", F.abs))
    u = F.transform("x", lambda v: v / F.col("big"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, v: a + v * v))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate("u", F.lit(0.0), lambda a, v: a + v) / (F.col("norm") * F.sqrt(F.size("u"))))))
    units = classes.withColumn("big", biggest).withColumn("u", u).withColumn("norm", norm)
    cells = units.select("class", "copies", "label", F.floor(angle / (step + 1e-9)).alias("cell"), F.size("u").alias("dim"), F.transform("u", lambda v: v / F.col("norm")).alias("u"))
    cells = stage(cells, "cells")  # angles and norms are computed once
    sizes = cells.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"))
    blocks = sizes.select("label", "dim", "cell", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    above = blocks.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("above"))
    below = blocks.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("below"))
    keys = ["label", "dim", "cell"]
    counts = blocks.join(above, keys, "left").join(below, keys, "left").na.fill(0, ["above", "below"])
    dealt = cells.join(counts, keys).withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")))
    mine, lit = F.col("mine"), F.lit
    own = F.transform(F.sequence(lit(0), F.col("blocks") - 1), lambda o: F.struct(F.col("cell").alias("a"), F.least(mine, o).alias("i"), F.col("cell").alias("b"), F.greatest(mine, o).alias("j")))
    count_to = lambda n: F.filter(F.sequence(lit(0).cast("long"), n), lambda o: o < n)
    up = F.transform(count_to(F.col("above")), lambda o: F.struct(F.col("cell").alias("a"), mine.alias("i"), (F.col("cell") + 1).alias("b"), o.alias("j")))
    down = F.transform(count_to(F.col("below")), lambda o: F.struct((F.col("cell") - 1).alias("a"), o.alias("i"), F.col("cell").alias("b"), mine.alias("j")))
    tiles = dealt.select("class", "copies", "label", "dim", "u", F.col("cell").alias("own_cell"), "mine", F.explode(F.concat(own, up, down)).alias("t")).select("class", "copies", "label", "dim", "u", "own_cell", "mine", "t.*")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class", ignore_index=True)
        x = np.stack(pdf["u"].to_numpy()).astype(np.float64)
        first = ((pdf["own_cell"] == pdf["a"]) & (pdf["mine"] == pdf["i"])).to_numpy()
        same = bool((pdf["a"].iloc[0] == pdf["b"].iloc[0]) and (pdf["i"].iloc[0] == pdf["j"].iloc[0]))
        at, to = (np.arange(len(pdf)), np.arange(len(pdf))) if same else (np.flatnonzero(first), np.flatnonzero(~first))
        ids, copies, n = pdf["class"].to_numpy(), pdf["copies"].to_numpy(), np.zeros(len(pdf), np.int64)
        parent, find = _forest(len(pdf))
        edges = []
        if len(at) and len(to):
            for i, js in tile_links(x[at], None if same else x[to], threshold):
                js, i = to[js], int(at[i])
                n[i] += copies[js].sum()
                np.add.at(n, js, copies[i])
                for j in js.tolist():
                    a, b = find(i), find(j)
                    if a != b:
                        parent[b] = a
                        edges.append((ids[i], ids[j]))
        some = np.flatnonzero(n)
        out = [pd.DataFrame({"class": ids[some], "other": pd.array([None] * len(some), "Int64"), "n": n[some]})]
        if edges:
            out.append(pd.DataFrame({"class": [a for a, _ in edges], "other": pd.array([b for _, b in edges], "Int64"), "n": 0}))
        return pd.concat(out, ignore_index=True)

    wide = max(64, partitions(spark))
    found = stage(tiles.repartition(wide, "label", "dim", "a", "i", "b", "j").groupBy("label", "dim", "a", "i", "b", "j").applyInPandas(link, "class long, other long, n long"), "vector-links")
    degree = found.where("other is null").groupBy("class").agg(F.sum("n").alias("n"))
    of = components(found.where("other is not null").select("class", "other")).withColumnsRenamed({"node": "class", "component": "low"})
    known = classes.join(degree, "class", "left").join(of, "class", "left")
    known = known.select(F.col("label").alias("_l"), F.col("x").alias("_x"), (F.coalesce("n", lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("low", "class").alias("_c"))
    usable_row = F.col("usable") & F.col("vec_id").isNotNull()
    joined = good.join(known, (F.col("label") == F.col("_l")) & (F.col("x") == F.col("_x"))).select("vec_id", F.col("_n").alias("n_links"), F.col("_c").alias("component_id"))
    rest = rows.where(~usable_row).select("vec_id", lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), lit(True)).alias("kept"))
