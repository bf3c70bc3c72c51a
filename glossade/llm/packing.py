"""Operator 3: packing by power-of-two decomposition.

A document of n ids (the closing id included) becomes floor(n / L) pieces of L and one piece for each binary digit of the
rest, largest first. Every piece is a sequence of its own whose length is a power of two, so nothing is padded and no
sequence crosses documents; a training batch draws from one bucket of equal lengths.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import bpe
from .shared import map_texts, texts


def piece_lengths(n: int, longest: int = 2048) -> list[int]:
    """Lengths of the pieces of n ids: the largest first; longest is a power of two."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if (n % longest) >> k & 1]


def pack(docs: DataFrame, vocabulary: str, longest: int = 2048, closing_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, bucket (log2 of length), ids_crc32, doc_tokens, sequence_id, offset, and ids if wanted.

    A null or empty text is the closing id alone. Rows that repeat or share a doc_id are packed each for itself;
    sequence_id is unique over all rows. A null doc_id stays null. No shuffle.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batch: pa.RecordBatch, values: list[str]):
        b = bpe(vocabulary)
        rows, start, length, crc, total, ids = [], [], [], [], [], []
        for i, v in enumerate(values):
            own = np.append(b.ids(v), closing_id).astype("<u4")
            raw, at = memoryview(own).cast("B"), 0
            for n in piece_lengths(len(own), longest):
                rows.append(i)
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                total.append(len(own))
                if with_ids:
                    ids.append(own[at : at + n].astype(np.int32))
                at += n
        out = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            out.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return map_texts(texts(docs), run, schema).select(
        "doc_id", "start", "length", F.log2("length").cast("int").alias("bucket"), "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length, so that a reader draws batches of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
