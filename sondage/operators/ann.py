"""Approximate vector search: vectors are dealt to cells around centres and kept as 8-bit codes; a query reads the cells nearest to it.

Every vector with a cosine is indexed: null, zero and non-finite vectors aren't
and find nothing as queries. Of equal similarities the smaller vec_id comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.functions.vectors import dot, norm

#: Vectors that the centres are fitted on, and how many of them serve as queries to choose the number of cells to read.
SAMPLE, ASKED = 16_384, 256
#: Centres at most, and the share of the nearest vectors that the cells read must hold on the sample.
CELLS, WANTED = 256, 0.97
#: Codes are rougher than vectors: so many times the limit is compared exactly.
REFINE = 4
#: Rows of an index and queries that meet in one task; crowded cells are dealt in tiles of about this size.
TILE_ROWS, TILE_QUERIES = 50_000, 2_000


@dataclass
class Model:
    centres: np.ndarray
    probes: int


def _usable(vector: Column) -> Column:
    n = norm(vector)
    return F.coalesce((n > 0) & (n < float("inf")), F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, cells: int = CELLS, rounds: int = 8, limit: int = 10) -> Model:
    """Centres of a bounded sample, drawn by the hash of vec_id, and the cells that hold its nearest vectors."""
    rows = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).where(_usable(F.col("vector")))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if sample.empty:
        return Model(np.zeros((1, 1)), 1)
    x = _unit(sample["vector"])
    centres = x[: max(1, min(cells, int(len(x) ** 0.5)))].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            total = x[nearest == c].sum(0)
            if (length := np.linalg.norm(total)) > 0:
                centres[c] = total / length
    nearest = (x @ centres.T).argmax(1)
    asked = x[-ASKED:]
    best = np.argsort(-(asked @ x.T), axis=1)[:, :limit]
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    needed = np.take_along_axis(order, nearest[best], axis=1)
    shares = [(needed < n).mean() for n in range(1, len(centres) + 1)]
    return Model(centres, 1 + next(i for i, share in enumerate(shares) if share >= WANTED))


def build(vectors: DataFrame, model: Model) -> DataFrame:
    """(vec_id, cell, code, low, step): the unit vector in 256 steps between its least and its greatest component."""
    centres = model.centres

    @F.pandas_udf("cell int, code binary, low double, step double")
    def coded(v: pd.Series) -> pd.DataFrame:
        if v.empty:
            return pd.DataFrame({"cell": [], "code": [], "low": [], "step": []})
        x = _unit(v)
        low = x.min(1)
        step = (x.max(1) - low) / 255
        codes = np.rint((x - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.uint8)
        return pd.DataFrame({"cell": (x @ centres.T).argmax(1).astype(np.int32), "code": [c.tobytes() for c in codes], "low": low, "step": step})

    rows = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).where(_usable(F.col("vector")))
    return rows.select("vec_id", coded("vector").alias("c")).select("vec_id", "c.*")


def save(index: DataFrame, folder: str, salts: int = 8) -> None:
    """A folder for each cell, so that a query's filter on cells skips the others; crowded cells are written by several tasks."""
    index.repartition(F.col("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(salts))).write.mode("overwrite").partitionBy("cell").parquet(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def _nearest(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The nearest rows of a tile for each of its queries, by their codes."""
    if rows.empty or asked.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "near": []})
    codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
    units = _unit(asked["vector"])
    # low + step * code, multiplied out
    near = (units @ codes.T) * rows["step"].to_numpy() + units.sum(1)[:, None] * rows["low"].to_numpy()
    n = min(keep, len(rows))
    top = np.argpartition(-near, n - 1, axis=1)[:, :n]
    return pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), n), "vec_id": rows["vec_id"].to_numpy()[top.ravel()], "near": np.take_along_axis(near, top, axis=1).ravel()})


def _first(rows: DataFrame, score: str, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "vec_id"))).where(F.col("rank") <= n)


def search(index: DataFrame, vectors: DataFrame, queries: DataFrame, model: Model, limit: int = 10, refine: int = REFINE) -> DataFrame:
    """(query_id, vec_id, rank, sim) of the limit nearest vectors found for each of queries: query_id, vector.

    A vector that is its own query is found as well. Cells and queries meet in tiles of bounded size."""
    centres, probes, keep = model.centres, model.probes, limit * refine

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.argsort(-(_unit(v) @ centres.T), axis=1)[:, :probes].astype(np.int32)) if len(v) else [], dtype=object)

    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(_usable(F.col("vector")))
    probing = asked.select("query_id", "vector", F.explode(cells("vector")).alias("cell"))
    # One row for each cell, of which there are CELLS at most.
    tiles = lambda rows, name, size: rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    plan = F.broadcast(tiles(index, "parts", TILE_ROWS).join(tiles(probing, "shares", TILE_QUERIES), "cell"))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(plan, "cell").select("vec_id", "code", "low", "step", "cell", part("vec_id", "parts").alias("part"), every("shares").alias("share"))
    right = probing.join(plan, "cell").select("query_id", "vector", "cell", every("parts").alias("part"), part("query_id", "shares").alias("share"))
    tile = ["cell", "part", "share"]
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {index.schema['vec_id'].dataType.simpleString()}, near double"
    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(lambda key, a, b: _nearest(key, a, b, keep), schema)
    near = _first(found, "near", keep).select("query_id", "vec_id")
    v, q = F.col("vector").cast("array<double>"), F.col("asked")
    pairs = near.join(vectors.select("vec_id", v.alias("vector")), "vec_id").join(asked.select("query_id", F.col("vector").alias("asked")), "query_id")
    exact = pairs.select("query_id", "vec_id", F.round(dot(F.col("vector"), q) / (norm(F.col("vector")) * norm(q)), 6).alias("sim"))
    return _first(exact, "sim", limit).select("query_id", "vec_id", "rank", "sim")
