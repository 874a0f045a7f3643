"""Graphs given as edge and node tables or as numpy archives."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.evaluation import running


def npz_edges(spark: SparkSession, path: str, key: str = "edge_index", rows: int = 1 << 16) -> DataFrame:
    """``src, dst`` of an integer array (2 x n or n x 2) in each numpy archive below ``path``; read on the executors."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                a = np.load(io.BytesIO(content), allow_pickle=False)[key]
                a = a if a.shape[1] == 2 else a.T
                for i in range(0, len(a), rows):
                    part = np.ascontiguousarray(a[i : i + rows].T).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], names=["src", "dst"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "src long, dst long")


def npz_labels(spark: SparkSession, path: str, key: str = "y") -> DataFrame:
    """``app_id, label`` by position of an integer array in a numpy archive."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                y = np.load(io.BytesIO(content), allow_pickle=False)[key].astype(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(y))), pa.array(y)], names=["app_id", "label"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "app_id long, label long")


def simple_edges(*relations: DataFrame) -> DataFrame:
    """The union of ``src, dst`` tables as distinct undirected edges ``src < dst`` of weight 1, without loops and nulls."""
    out = None
    for e in relations:
        part = e.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        out = part if out is None else out.union(part)
    return out.distinct().withColumn("weight", F.lit(1))


def labelled_graph(nodes: DataFrame, edges: DataFrame, drop=(0,), positive=(1,)) -> tuple[DataFrame, DataFrame]:
    """Nodes ``app_id, node, y`` whose label is not in ``drop``, renumbered from 0 by id, and the edges between them."""
    kept = nodes.where(F.col("label").isNotNull() & ~F.col("label").isin(list(drop))).select("app_id", F.col("label").isin(list(positive)).cast("int").alias("y"), F.lit(1).alias("one"))
    kept = running(kept, [], "app_id", ["one"]).select("app_id", (F.col("run_one") - 1).alias("node"), "y")
    end = lambda c: kept.select(F.col("app_id").alias(c), F.col("node").alias(f"n_{c}"))
    inside = edges.join(end("src"), "src").join(end("dst"), "dst").select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst"))
    return kept, simple_edges(inside)
