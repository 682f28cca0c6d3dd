"""Parquet stores of item codes and programs, and readers of outside files."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.operators.encode import Encoder, encode
from facetrank.operators.program import Program, check_name

VERSION = 1
PROGRAM_SCHEMA = (
    "generation string, dim int, planes array<array<bigint>>, weight_lo double, weight_scale double, base double, sum_w double, "
    "calibration_a double, calibration_b double, positive_rate double, name string"
)


def write_index(items: DataFrame, encoder: Encoder, path: str, *, embedding: str = "embedding", overwrite: bool = False) -> None:
    """Codes and the encoder's one row; an index that is there is an error unless ``overwrite``."""
    spark, mode = items.sparkSession, "overwrite" if overwrite else "errorifexists"
    encode(items, encoder, embedding).write.mode(mode).parquet(f"{path}/codes")
    rotation = None if encoder.projection is None else [list(r) for r in encoder.projection]
    row = [(VERSION, encoder.generation, encoder.dim, encoder.seed, list(encoder.centroid), rotation)]
    spark.createDataFrame(row, "version int, generation string, dim int, seed int, centroid array<double>, projection array<array<double>>").coalesce(1).write.mode(mode).parquet(f"{path}/encoder")


def append_items(items: DataFrame, path: str, embedding: str = "embedding") -> None:
    """More items under the frozen encoder; nothing that is stored is read or written again."""
    encode(items, read_encoder(items.sparkSession, path), embedding).write.mode("append").parquet(f"{path}/codes")


def read_encoder(spark: SparkSession, path: str) -> Encoder:
    row = spark.read.parquet(f"{path}/encoder").first()
    if row["version"] != VERSION:
        raise ValueError(f"index of version {row['version']}; this library reads {VERSION}")
    rotation = None if row["projection"] is None else tuple(map(tuple, row["projection"]))
    return Encoder(tuple(row["centroid"]), rotation, row["generation"], row["seed"])


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/codes")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row that describes an index."""
    encoder = read_encoder(spark, path)
    kind = "identity" if encoder.projection is None else "orthogonal"
    return read_codes(spark, path).agg(F.count(F.lit(1)).alias("n_items")).select(
        F.lit(VERSION).alias("version"), "n_items", F.lit(encoder.dim).alias("dim"), F.lit(encoder.packed_bytes).alias("packed_bytes"),
        F.lit(2).alias("correction_values"), F.lit(kind).alias("projection_kind"), F.lit(encoder.seed).alias("seed"), F.lit(encoder.item_bytes).alias("item_bytes"),
    )


class ProgramStore:
    """Programs as one Parquet data set with a folder per name, so that one is read or replaced by itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.held: dict[str, Program] = {}

    def _all(self) -> DataFrame:
        return self.spark.read.schema(PROGRAM_SCHEMA).parquet(self.path)

    def save(self, programs: Program | Iterable[Program], overwrite: bool = True) -> None:
        programs = [programs] if isinstance(programs, Program) else list(programs)
        names = [check_name(p.name) for p in programs]
        if not overwrite and set(names) & set(self.names()):
            raise FileExistsError(f"there already: {sorted(set(names) & set(self.names()))}")
        rows = [(p.generation, p.dim, [list(x) for x in p.planes], p.weight_lo, p.weight_scale, p.base, p.sum_w, p.calibration_a, p.calibration_b, p.positive_rate, p.name) for p in programs]
        table = self.spark.createDataFrame(rows, PROGRAM_SCHEMA).repartition("name")
        table.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("name").parquet(self.path)
        for name in names:
            self.held.pop(name, None)

    def names(self) -> list[str]:
        try:
            rows = self._all().select("name").distinct().orderBy("name").collect()  # one row a program
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return [r["name"] for r in rows]

    def load(self, name: str) -> Program:
        if name not in self.held:
            row = self._all().where(F.col("name") == check_name(name)).first()
            if row is None:
                raise KeyError(name)
            fields = row.asDict() | {"planes": tuple(map(tuple, row["planes"]))}
            self.held[name] = Program(**fields)
        return self.held[name]


def write_labelled_text(rows: DataFrame, path: str) -> None:
    """Result tables as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, embedding) of a two-dimensional .npy file, read through the cluster's file system in one piece per file."""
    import io

    import numpy as np
    import pandas as pd

    def run(frames):
        for frame in frames:
            for data in frame["content"]:
                x = np.load(io.BytesIO(data), allow_pickle=False)
                for at in range(0, len(x), 8192):
                    part = x[at : at + 8192].astype(np.float32)
                    yield pd.DataFrame({"row_id": np.arange(at, at + len(part)), "embedding": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row_id bigint, embedding array<float>")


def key_values(text: Column | str) -> Column:
    """``k=v`` lines of a run's output as a map."""
    column = F.col(text) if isinstance(text, str) else text
    return F.str_to_map(F.trim(column), F.lit("\n"), F.lit("="))


def environment(spark: SparkSession) -> dict[str, object]:
    import platform
    import sys

    return {"python": sys.version.split()[0], "spark": spark.version, "platform": platform.platform(), "parallelism": spark.sparkContext.defaultParallelism}


def config_hash(config: dict, n: int = 10) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:n]
