"""Exports of whole indexes, raw typed files, manifests, tables kept under a key, and generated inputs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.operators.encode import Encoder, encode
from facetrank.operators.program import Program
from facetrank.operators.quantize import pack, pq_codes
from facetrank.sources.session import prepare
from facetrank.sources.store import ProgramStore, config_hash, environment

#: Kinds of raw files: little-endian numbers without a header.
RAW = {"u8": "<u1", "u16": "<u2", "u32": "<u4", "f32": "<f4"}


def read_raw(spark: SparkSession, path: str, kind: str, width: int) -> DataFrame:
    """(file, row_id, values) of files of raw numbers, ``width`` of them a row; row_id counts within a file."""
    if kind not in RAW:
        raise ValueError(f"no such kind of raw file: {kind}")
    prepare(spark)
    item = "float" if kind == "f32" else "bigint"
    out = np.float32 if kind == "f32" else np.int64

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                flat = np.frombuffer(data, RAW[kind])
                if len(flat) % width:
                    raise ValueError(f"{name} has {len(flat)} numbers, not a multiple of {width}")
                rows = flat.reshape(-1, width)
                for at in range(0, len(rows), 8192):
                    part = rows[at : at + 8192].astype(out)
                    yield pd.DataFrame({"file": name, "row_id": np.arange(at, at + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, row_id bigint, values array<{item}>")


def raw_bytes(values: Column | str, kind: str = "f32") -> Column:
    """An array column as the bytes of a raw file's row, for tables that are handed to readers of raw numbers."""
    column = F.col(values) if isinstance(values, str) else values

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else np.asarray(x).astype(RAW[kind]).tobytes())

    return packed(column)


def write_json(spark: SparkSession, path: str, record: dict, overwrite: bool = True) -> None:
    """One JSON record, such as a manifest or a run's headline."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def run_manifest(spark: SparkSession, config: dict) -> dict:
    """What a result came from: configuration and its hash, run id, environment, revision and processor."""
    import datetime
    import platform
    import subprocess

    from facetrank.sources.session import ROOT

    try:
        revision = subprocess.run(["git", "-C", ROOT, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        revision = ""
    try:
        with open("/proc/cpuinfo") as lines:
            cpu = next((x.partition(":")[2].strip() for x in lines if x.startswith("model name")), "")
    except OSError:
        cpu = ""
    at = datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    key = config_hash(config)
    return {"run_id": f"{at}-{key}", "config": config, "config_hash": key, "revision": revision, "cpu": cpu or platform.processor(), **environment(spark)}


def kept_table(spark: SparkSession, folder: str, meta: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written once under a hash of ``meta`` and read from there ever after."""
    path = f"{folder.rstrip('/')}/{config_hash(meta, 16)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def export_assets(items: DataFrame, encoder: Encoder, programs: list[Program], path: str, *, small: Column | None = None, dim: int = 0, bits: int = 2, book: object = None, embedding: str = "embedding", item_id: str = "vec_id", overwrite: bool = False) -> dict:
    """One Parquet table for each representation of the items (vectors, codes, and, where given, packed small codes and
    PQ codes), the programs, and a manifest that is also returned. ``small`` gives an item's small codes."""
    spark, mode = items.sparkSession, "overwrite" if overwrite else "errorifexists"
    tables = {"dense": items.select(item_id, F.col(embedding).cast("array<float>").alias("vector")), "binary": encode(items, encoder, embedding, keep=[item_id])}
    if small is not None:
        tables["lut"] = items.select(item_id, pack(small, dim, bits).alias("packed"))
    if book is not None:
        tables["pq"] = items.select(item_id, pq_codes(embedding, book).alias("codes"))
    for name, table in tables.items():
        table.write.mode(mode).option("compression", "zstd").parquet(f"{path}/{name}")
    ProgramStore(spark, f"{path}/programs").save(programs)
    record = {"n_items": items.count(), "dim": encoder.dim, "generation": encoder.generation, "tables": sorted(tables), "programs": sorted(p.name for p in programs)}
    write_json(spark, f"{path}/manifest", record, overwrite)
    return record


def random_items(spark: SparkSession, n: int, dim: int, seed: int = 7) -> DataFrame:
    """(vec_id, embedding) of unit vectors drawn by a hash, the same for the same seed."""
    def normal(i: int) -> Column:
        u, v = ((F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i), F.lit(k)), F.lit(1 << 30)) + 0.5) / float(1 << 30) for k in (0, 1))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)

    from facetrank.functions.numeric import normalise

    drawn = spark.range(n).select(F.col("id").alias("vec_id"), "id", F.array(*map(normal, range(dim))).alias("v"))
    return drawn.select("vec_id", F.transform(normalise("v"), lambda x: x.cast("float")).alias("embedding"))


def random_bytes(spark: SparkSession, n: int, width: int, seed: int = 7) -> DataFrame:
    """(id, values) of bytes drawn by a hash."""
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(256)).cast("int")).alias("values"))
