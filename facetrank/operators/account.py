"""Storage accounting: bytes an item, bytes a program and shared bytes of each representation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.functions.numeric import decimal_gb, decimal_mb


@dataclass(frozen=True)
class Footprint:
    method: str
    item_bytes: int
    program_bytes: int
    shared_bytes: int = 0
    active_program_bytes: int = 0


def footprints(dim: int = 384, pq_parts: int = 64, pq_size: int = 256, lut_terms: int = 28, lut_pairs: int = 2) -> list[Footprint]:
    """Each representation at a dimension; tables hold 4-byte entries, coordinates are 2 bytes."""

    def lut(bits: int) -> Footprint:
        bins = 1 << bits
        unary, pairs = lut_terms - 2 * lut_pairs, lut_pairs
        return Footprint(f"lut_{bits}bit", dim * bits // 8, unary * (2 + 4 * bins) + pairs * (4 + 4 * bins * bins) + 12)

    linear = 4 * dim + 4
    return [
        Footprint("binary1_ls2_int4", -(-dim // 8) + 8, 4 * -(-dim // 8) + 24),
        Footprint(f"pq{pq_parts}_linear", pq_parts, linear + 8, pq_size * dim * 4, pq_parts * pq_size * 4 + 12),
        lut(2),
        lut(4),
        Footprint("fp32_linear", 4 * dim, linear + 8),
        Footprint("dense", 4 * dim, 0),
    ]


def storage_table(spark: SparkSession, n_items: int, n_programs: int, dim: int = 384, **sizes) -> DataFrame:
    """One row per representation: bytes of items, programs, shared tables, and the total in decimal units."""
    rows = [(f.method, f.item_bytes, f.program_bytes, f.shared_bytes) for f in footprints(dim, **sizes)]
    table = spark.createDataFrame(rows, "method string, item_bytes bigint, program_bytes bigint, shared_bytes bigint")
    table = table.withColumn("total_bytes", F.col("item_bytes") * n_items + F.col("program_bytes") * n_programs + F.col("shared_bytes"))
    return table.withColumns({"total_mb": decimal_mb(F.col("total_bytes")), "total_gb": decimal_gb(F.col("total_bytes"))})
