"""Best-fit packing of token pieces into sequences, by hierarchical residual merging.

Documents are encoded and only those longer than a sequence are cut. Partitions pack their pieces by best fit,
longest first; bins that are nearly full are done. The others become items of the next round, where fewer
partitions pack whole bins by best fit again, until one partition is left or a round saves next to nothing.
A task never gets more than about ``ITEMS`` items, and every round is a table in the shared folder, so a lost
executor costs a part of one round and never changes a packing that others have read.

Null text is the empty text, a document of one end token. Ties in length go by piece number. Repeated rows are
packed one by one. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokenise
from .common import by_value, cut, text_of

by_value(__name__)

SIZE = 2048
#: Items a task packs at most, about; bins with no more room than NEARLY are done.
ITEMS, NEARLY = 50_000, 4
#: A round that leaves more than this share of its bins is the last.
SAVES = 0.995


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, its ids followed by ``end``."""
    tail = int(end).to_bytes(4, "little")

    def run(batches):
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(b.column(0).to_pylist(), tokenise.token_ids(b.column(1).to_pylist(), path)):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    for column, v in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, order: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best fit in the given order: bin and offset of each item, and the number of bins.

    Bins with equal room lie on one stack; a bit mask of the rooms that occur finds the least that suffices.
    """
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    mask, n = 0, 0
    values = lengths.tolist()
    for i in order.tolist():
        need = values[i]
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            b, room, n = n, size, n + 1
        where[i], offset[i] = b, size - room
        if left := room - need:
            stacks[left].append(b)
            mask |= 1 << left
    return where, offset, n


def _round(items: DataFrame, parts: int, level: int, size: int) -> DataFrame:
    """(item, bin, offset, fill) for (item, length)."""
    from pyspark import TaskContext

    def run(batches):
        pdf = pd.concat(list(batches) or [pd.DataFrame({"item": [], "length": []})])
        if not len(pdf):
            return
        item, length = pdf["item"].to_numpy(np.int64), pdf["length"].to_numpy(np.int64)
        where, offset, n = best_fit(length, np.lexsort((item, -length)), size)
        fill = np.bincount(where, length, n).astype(np.int64)
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        yield pd.DataFrame({"item": item, "bin": base + where, "offset": offset, "fill": fill[where]})

    dealt = items.repartition(parts, "item") if parts > 1 else items.coalesce(1)
    return dealt.mapInPandas(run, "item long, bin long, offset long, fill long")


def pack(spark: SparkSession, found: DataFrame, size: int = SIZE) -> DataFrame:
    """``found`` (with a length column) with sequence_id and offset."""
    rows = cut(spark, found.withColumn("item", F.monotonically_increasing_id()), "pieces")
    items = rows.filter(F.col("length") < size).select("item", "length")
    n = items.count()
    levels = []
    while n:
        parts = max(1, -(-n // ITEMS))
        done = cut(spark, _round(items, parts, len(levels) + 1, size), "round")
        levels.append(done)
        items = done.filter(F.col("fill") < size - NEARLY).groupBy(F.col("bin").alias("item")).agg(F.max("fill").alias("length"))
        left = items.count()
        if parts == 1 or left > SAVES * n and len(levels) > 1:
            break
        n = left
    out = rows.withColumn("sequence_id", F.when(F.col("length") >= size, -F.col("item") - 1)).withColumn("at", F.lit(0).cast("long")).withColumn("inside", F.col("item"))
    for k, level in enumerate(levels):
        step = level.select(F.col("item").alias("inside"), F.col("bin").alias("to"), F.col("offset").alias("more"))
        out = out.join(step, "inside", "left").withColumn("at", F.col("at") + F.coalesce("more", F.lit(0))).withColumn("inside", F.coalesce("to", "inside")).drop("to", "more")
    return out.select(*found.columns, F.coalesce("sequence_id", "inside").alias("sequence_id"), F.col("at").alias("offset"))
