"""Best-fit packing under conflicts: no two texts of one source or one duplicate cluster share a bin.

Rules for unusual input
-----------------------
null or empty text     one token, the end, like any other short text
very long text         cut into full bins and a rest; the rest is packed like a short text
null source            in conflict with nothing; null cluster likewise
null doc_id            packed like any other
ties                   pieces of equal size in the order of id, source and cluster; of equally tight bins the oldest
repeated rows          copies: the same cluster, so different bins; any number of them is spread over the groups
extra columns          ignored
empty table            empty result
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .scratch import materialize, working
from .token_counts import token_counts

CAPACITY = 4096
GROUP = 8000  # rows that are packed together, about
EACH = 1 << 16  # equal rows that are written out at once


class Bins:
    """Bins ordered by residual, each with a bitmap of its sources and one of its clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]  # by residual: bin numbers, ascending
        self.filled = 0  # bit r: some bin has residual r
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece; source and cluster are bits, 0 for none.

        The successor search starts at the least residual that holds the piece and goes on until a bin there is
        compatible; among bins of that residual the oldest is taken.
        """
        left = self.filled >> size << size
        while left:
            residual = (left & -left).bit_length() - 1
            here = self.open[residual]
            for i, b in enumerate(here):
                if not self.sources[b] & source and not self.clusters[b] & cluster:
                    del here[i]
                    if not here:
                        self.filled ^= 1 << residual
                    self._enter(b, residual - size, source, cluster)
                    return b, self.capacity - residual
            left &= left - 1
        self.sources.append(0)
        self.clusters.append(0)
        b = len(self.sources) - 1
        self._enter(b, self.capacity - size, source, cluster)
        return b, 0

    def _enter(self, b: int, residual: int, source: int, cluster: int) -> None:
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if residual:
            insort(self.open[residual], b)
            self.filled |= 1 << residual


def pack_group(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int]]:
    """``(row, bin, offset, length)`` of every piece, rows taken in the order given."""
    bins, bits = Bins(capacity), ({}, {})

    def bit(kind: int, value) -> int:
        return 0 if value is None else 1 << bits[kind].setdefault(value, len(bits[kind]))

    out = []
    for row, (size, source, cluster) in enumerate(zip(sizes, sources, clusters)):
        s, c = bit(0, source), bit(1, cluster)
        for length in [capacity] * (size // capacity) + [size % capacity] * bool(size % capacity):
            out.append((row, *bins.put(length, s, c), length))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces of ``docs(doc_id, n_tokens, source, cluster)``: ``(doc_id, part, bin_id, bin_offset, length)``.

    Rows are dealt by a hash of all that they have into groups of about ``group`` rows, and each group is packed by one
    task, largest first; groups share no bin.  Equal rows are counted and numbered first, so that they are dealt like
    others.  A hot source or cluster is spread over all groups; a third of a group may have one source, which costs
    one bin each, so a group's search is bounded by its rows squared.
    """
    columns = ["doc_id", "n_tokens", "source", "cluster"]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    counted = own.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_a", F.explode(F.expr(f"sequence(0L, (_n - 1) div {EACH})")))
    each = counted.withColumn("_b", F.explode(F.expr(f"sequence(0L, least({EACH}, _n - _a * {EACH}) - 1)")))
    groups = max(1, -(-docs.count() // group))
    dealt = each.withColumn("_group", F.pmod(F.xxhash64(*columns, "_a", "_b"), F.lit(groups))).drop("_n", "_a", "_b")
    # pandas would turn a long column with nulls into doubles
    dealt = dealt.withColumns({"_none": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "_none", "doc_id", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        names = lambda c: [x if isinstance(x, str) else None for x in pdf[c].tolist()]
        made = pack_group(pdf["n_tokens"].tolist(), names("source"), names("cluster"), capacity)
        got = pd.DataFrame(made, columns=["row", "bin", "bin_offset", "length"], dtype=np.int64)
        part = got.groupby("row").cumcount() if len(got) else got["row"]
        ids, none = (pdf[c].take(got["row"]).reset_index(drop=True) for c in ("doc_id", "_none"))
        return pd.DataFrame({"doc_id": ids, "none": none, "part": part, "bin_id": got["bin"] * groups + key[0], "bin_offset": got["bin_offset"], "length": got["length"]})

    packed = dealt.groupBy("_group").applyInPandas(run, "doc_id long, none boolean, part long, bin_id long, bin_offset long, length long")
    return packed.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")


def with_sizes(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, source, cluster)``: the model's tokens and an end; near copies by their fingerprints are one cluster.

    ``source`` and ``cluster`` are 64-bit names.
    """
    rows = docs.select("doc_id", text, F.xxhash64("source").alias("source"), F.col("source").isNull().cast("long").alias("unsourced"))
    made = (("fp",), lambda data, offsets: {"fp": simhash.quick_fingerprints(data, offsets).view(np.int64)})
    with working(docs.sparkSession):
        sized = materialize(token_counts(rows, model, text, ("source", "unsourced"), made), lasting=True)
    clustered = sized.join(simhash.labelled(sized), "fp")
    return clustered.select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens"), F.when(F.col("unsourced") == 0, F.col("source")).alias("source"), F.col("label").alias("cluster"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(with_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")))
