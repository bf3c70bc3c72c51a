"""Operator 1: token counts of whole texts by overlap resynchronisation (the splice is in bpe.py)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import CHUNK, OVERLAP, bpe
from .shared import map_texts, texts


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row a row of docs.

    A null or empty text has 0 tokens; a null doc_id stays null; repeated rows stay; other columns are not looked at.
    No shuffle: each row is counted where it is read. vocabulary is a path that every executor has.
    """

    def count(batch: pa.RecordBatch, values: list[str]) -> pa.RecordBatch:
        b = bpe(vocabulary)
        n = np.fromiter((len(b.ids(v, chunk, overlap)) for v in values), dtype=np.int64, count=len(values))
        size = np.fromiter((len(v.encode()) for v in values), dtype=np.int64, count=len(values))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_texts(texts(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
