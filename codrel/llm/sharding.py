"""Range sharding by sampled splitters.

A record's key is (hash of its text, doc_id), so equal texts lie side by side and the order
has nothing to do with sources or lengths. A sample whose chance of a draw grows with a
record's size gives quantile boundaries; every record is then put into its range, the exact
bytes of each range are counted, and ranges above their share are divided again by a sample
of their own until none is overfull. A record's shard follows from the bytes before it.

Law ``bytes``: shard sizes differ by little more than the largest record or group. A group of
equal texts stays in one shard; only one above a 64th of a shard is divided, by doc_id, where
near-equal sizes need it.

Defined results: a null text has size 1 and is apart from empty texts only by its missing
crc, which is that of the empty text; rows that repeat an id and text are all placed; an
empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_or_least, shown_id, text_or_empty, written

#: Ranges aimed at for each shard, and rows drawn for each range.
RANGES_PER_SHARD, DRAWS_PER_RANGE = 128, 12
ROUNDS = 6


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key; the texts themselves go no further."""
    text = text_or_empty()
    return docs.select(
        id_or_least().alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def _codes(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys and ids as one sortable column."""
    out = np.empty(len(keys), dtype=[("k", "<i8"), ("d", "<i8")])
    out["k"], out["d"] = keys, ids
    return out


def _ranged(rows: DataFrame, splits: np.ndarray) -> DataFrame:
    """Adds range: the number of splitters at or below the key."""
    firsts, raw = splits["k"].copy(), splits.copy()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, ids = pdf["key"].to_numpy(), pdf["doc_id"].to_numpy()
            lo, hi = np.searchsorted(firsts, keys, "left"), np.searchsorted(firsts, keys, "right")
            for at in np.unique(lo[hi > lo]):  # keys that splitters share: the ids decide
                mine = (lo == at) & (hi > lo)
                same = raw["d"][at : hi[mine][0]]
                hi[mine] = at + np.searchsorted(same, ids[mine], "right")
            yield pdf.assign(range=hi.astype("int64"))

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", range long"
    return rows.mapInPandas(place, schema)


def _sample(rows: DataFrame, total: int, draws: int) -> np.ndarray:
    """Keys drawn with a chance in proportion to size; sizes above total / draws are always drawn. Deterministic by key."""
    chance = F.col("size") * F.lit(draws / max(1, total))
    coin = F.pmod(F.xxhash64("doc_id", "key", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    got = rows.filter(coin < chance).select("key", "doc_id").toPandas()
    return np.sort(_codes(got["key"].to_numpy(np.int64), got["doc_id"].to_numpy(np.int64)), order=["k", "d"])


def _whole_groups(sample: np.ndarray) -> np.ndarray:
    """Splitters that lie before the first row of their key."""
    out = sample.copy()
    out["d"] = -(2**63)
    return np.unique(out)


def shard(docs: DataFrame, shards: int = 8, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The driver holds about shards * ranges_per_shard * DRAWS_PER_RANGE sampled keys and one
    row per range, whatever the input's size.
    """
    spark = docs.sparkSession
    rows = written(keyed(docs), "keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    sample = _sample(rows, total, ranges * DRAWS_PER_RANGE)
    splits = _whole_groups(sample[len(sample) // ranges :: max(1, len(sample) // ranges)])
    most = 2 * total / ranges
    for _ in range(ROUNDS):
        placed = _ranged(rows, splits)
        sizes = placed.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi")).toPandas()
        full = sizes[(sizes["size"] > most) & (sizes["rows"] > 1)]
        if full.empty:
            break
        grown = splits
        for one_key in (False, True):  # a range of one key is a group of equal texts: only ids divide it
            some = full[(full["lo"] == full["hi"]) == one_key]
            if len(some):
                over = placed.join(F.broadcast(spark.createDataFrame(some[["range"]])), "range")
                size = int(some["size"].sum())
                more = _sample(over, size, max(64, int(4 * size / most)))
                grown = np.unique(np.concatenate([grown, more if one_key else _whole_groups(more)]))
        if len(grown) == len(splits):
            break
        splits = grown
    sizes = sizes.sort_values("range")
    plan = spark.createDataFrame(
        [(int(r.range), int(b), int(n)) for r, b, n in zip(sizes.itertuples(), sizes["size"].cumsum() - sizes["size"], sizes["rows"].cumsum() - sizes["rows"], strict=True)],
        "range long, bytes_before long, rows_before long",
    )
    order = Window.partitionBy("range").orderBy("key", "doc_id", "text_crc32")
    group = Window.partitionBy("range", "key")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    group_size = F.col("group_end") - F.col("group_start")
    middle = F.when(group_size <= F.lit(total / (shards * 64)), (F.col("group_start") + F.col("group_end")) / 2).otherwise(F.col("upto") - F.col("size") / 2)
    put = written(
        placed.withColumns({"upto": upto, "at": F.row_number().over(order)})
        .withColumns({"group_start": F.min(F.col("upto") - F.col("size")).over(group), "group_end": F.max("upto").over(group)})
        .join(F.broadcast(plan), "range")  # one row a range
        .select(
            "doc_id", "size", "text_crc32",
            F.least(F.lit(shards - 1), F.floor((F.col("bytes_before") + middle) * shards / F.lit(max(1, total)))).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("at") - 1).alias("row"),
        ),
        "placed",
    )
    first = put.groupBy("shard").agg(F.min("row").alias("first"))
    return put.join(F.broadcast(first), "shard").select(  # one row a shard
        shown_id(F.col("doc_id")).alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
