"""Repeated draws without replacement from cells of rows, as sums of what was drawn: rows are never copied by replicate.

Rows that agree in their key are one row with a count. A cell is dealt into chunks by a hash of the key, so that a cell of
any size is many tasks; how many of a replicate's rows fall in each chunk is a multivariate hypergeometric draw over the
chunks' sizes, and which ones is a draw inside the chunk. Both are seeded by cell, chunk and replicate and start from rows
in the order of their keys, so the result depends on the rows alone: not on partitions, tasks or what was lost and made again.

A cell has fewer than 10^9 rows, the bound of NumPy's draw; a larger one fails.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import with_package, written

CHUNK_ROWS, BLOCK = 1 << 15, 32


def row_key(*columns: str | Column) -> Column:
    """A row's identity from its raw columns: equal exactly for rows that agree in all of them."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def picked(weights: np.ndarray, take: int, seed: list[int]) -> np.ndarray:
    """How often each of the rows, of which there are ``weights``, is among ``take`` drawn without replacement."""
    rng = np.random.default_rng(seed)
    if (weights == 1).all():
        out = np.zeros(len(weights), np.int64)
        out[rng.permutation(len(weights))[:take]] = 1
        return out
    return rng.multivariate_hypergeometric(weights, take)


def drawn_sums(rows: DataFrame, cells: DataFrame, keys: list[str], key: str, columns: list[str], reps: int, seed: int, products: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, rep, n, s: sums, q: flat matrix of the products' sums) of the rows drawn from each cell, for each replicate.
    rows: (keys, key, columns), without nulls in columns. cells: (keys, k), the number to draw, at most the cell's rows."""
    with_package(rows.sparkSession)
    d = len(columns)
    folded = rows.groupBy(*keys, key, *columns).agg(F.count(F.lit(1)).alias("w"))
    sizes = folded.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct")).join(cells, keys)
    chunks = F.ceil(F.col("distinct") / chunk_rows)
    cell = F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << 62) - 1)).alias("cell")
    # a row per cell: a merge join would bring all rows of a cell to one task, to be sorted there
    placed = folded.join(F.broadcast(sizes), keys).select(*keys, key, *columns, "w", "k", cell, F.pmod(F.xxhash64(F.lit(seed), key), chunks).alias("chunk"))
    placed = written(placed, "cells")

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        """Of a cell, how many rows of each chunk each replicate takes."""
        group = group.sort_values("chunk")
        rng = np.random.default_rng([seed, int(group["cell"].iloc[0])])
        takes = rng.multivariate_hypergeometric(group["m"].to_numpy(), int(group["k"].iloc[0]), size=reps)
        return group[[*keys, "chunk"]].assign(takes=list(takes.T))

    marks = placed.groupBy(*keys, "cell", "k", "chunk").agg(F.sum("w").alias("m"))
    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    takes = marks.groupBy(*keys).applyInPandas(deal, kinds + "chunk long, takes array<long>")

    def add(group: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        x, w = group[columns].to_numpy(float), group["w"].to_numpy()
        z = np.hstack([x, (x[:, :, None] * x[:, None, :]).reshape(len(x), d * d)]) if products else x
        counts, who, out = dealt["takes"].iloc[0], [seed, int(group["cell"].iloc[0]), int(group["chunk"].iloc[0])], []
        for at in range(0, reps, BLOCK):
            c = np.stack([picked(w, int(counts[r]), [*who, r]) for r in range(at, min(reps, at + BLOCK))])
            out += zip(c.sum(1).tolist(), c @ z)
        some = pd.DataFrame({"rep": range(reps), "n": [n for n, _ in out], "m": [m for _, m in out]})
        return some.assign(**{k: group[k].iloc[0] for k in keys})[[*keys, "rep", "n", "m"]]

    both = placed.groupBy(*keys, "chunk").cogroup(takes.groupBy(*keys, "chunk"))
    parts = both.applyInPandas(add, kinds + "rep int, n long, m array<double>")
    sums = [F.sum(F.get("m", F.lit(i))) for i in range(d + d * d * products)]
    out = parts.groupBy(*keys, "rep").agg(F.sum("n").alias("n"), F.array(*sums[:d]).alias("s"), *([F.array(*sums[d:]).alias("q")] if products else []))
    return out
