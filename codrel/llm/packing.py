"""Best-fit packing of token pieces under several capacities (vector best-fit).

``pieces`` cuts each document's ids into pieces of at most one sequence; ``pack`` gives every
piece a sequence and an offset. A sequence has three residual capacities: tokens, documents,
and attention cost (the sum of squared piece lengths). A piece goes to the open sequence that
can take it under every capacity and scores best: either the smallest weighted norm of the
residual that would remain, or the largest weighted dot product of demand and residual.

Pieces are dealt at random into groups of a bounded number of tokens and each group is packed
by one task, so the work is linear in the input and at most one part-filled sequence per group
is lost against packing everything together.

With weights on all three, a choice weighs how full a sequence is in every respect: of two
sequences with nearly the same room left, the one whose documents or attention cost are nearer
their capacities is taken. Capacities that the token capacity implies never refuse a piece.

Defined results: a null or empty text is one piece holding only the end id; equal documents
are packed separately, and so are rows that repeat an id or have none, however many (groups are
dealt by a written row number, not by id); a very long text becomes as many full pieces as it
fills and one shorter first piece; of pieces that tie, the smaller id and piece number goes
first, and of sequences that tie, the one opened first among those in reach; a piece longer than
the token capacity is an error; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_or_least, shown_id, text_or_empty, written

#: Weights of tokens, documents and attention cost in the residual.
WEIGHTS = (1.0, 0.1, 0.1)
#: The row number that deals pieces into groups.
_ROW = "_piece_row"
#: Documents encoded in one call.
_BATCH = 256


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    Only documents above ``capacity`` are cut: the first piece takes what is left over, the
    others are full. A null id is the smallest long here, and null again in ``packed``.
    """

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                rows = []
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    rows += [(doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    source = docs.select(id_or_least().alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the given order (longest first packs best)."""
    caps, w = np.array(capacities, float), np.array(weights, float)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.empty((max(1, n), 3))
    open_ = np.empty(max(1, n), np.int64)
    n_open = n_bins = 0
    least = int(lengths.min()) if n else 0
    for k, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) * length])
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity {capacities}")
        best = -1
        if n_open:
            rest = left[open_[:n_open]]
            fits = ((rest - need) >= 0).all(axis=1)
            if fits.any():
                if rule == "norm":
                    score = (((rest - need) / caps) ** 2 * w).sum(axis=1)
                else:
                    score = -(rest / caps * (need / caps) * w).sum(axis=1)
                best = int(np.where(fits, score, np.inf).argmin())
        if best < 0:
            left[n_bins], best = caps, n_open
            open_[n_open] = n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        at = open_[best]
        bins[k], offsets[k] = at, int(caps[0] - left[at][0])
        left[at] -= need
        if left[at][0] < least or left[at][1] < 1:  # nothing fits there any more
            open_[best] = open_[n_open - 1]
            n_open -= 1
    return bins, offsets


def pack(
    parts: DataFrame,
    capacity: int = 2048,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    tokens_per_group: int = 1 << 22,
) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (doc_id, piece, length and more).

    ``max_documents`` and ``max_attention`` default to what ``capacity`` already implies. Pieces are
    dealt by ``_piece_row`` if the table has it, so that no id puts many into one group.
    """
    caps = (float(capacity), float(max_documents or capacity), float(max_attention or capacity**2))
    total = parts.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / tokens_per_group))
    columns = [c for c in parts.columns if c != _ROW]

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(pdf["length"].to_numpy(), caps, weights, rule)
        return pdf[columns].assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    schema = ", ".join(f"{n} {t}" for n, t in parts.dtypes if n != _ROW) + ", sequence_id long, offset long"
    dealt = F.xxhash64(_ROW) if _ROW in parts.columns else F.xxhash64(*columns)
    grouped = parts.withColumn("_group", F.pmod(dealt, F.lit(groups))).drop(_ROW)
    return grouped.groupBy("_group").applyInPandas(fill, schema)


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, **limits) -> DataFrame:
    """``pieces`` once into the shared folder, then ``pack``."""
    made = written(pieces(docs, tokenizer, capacity, end_id).withColumn(_ROW, F.monotonically_increasing_id()), "pieces")
    out = pack(made, capacity, **limits)
    return out.withColumn("doc_id", shown_id(F.col("doc_id")))
