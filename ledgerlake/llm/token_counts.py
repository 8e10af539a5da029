"""Token counts of whole texts (operator 9).

Arrow functions that return lengths only: texts go through the tokenizer in
batches balanced by bytes (``slices``: many short texts or one long text), long
texts, whatever white space or special strings they hold, are split at places
where splitting cannot change the tokens and their parts batched by bytes again
(see ``tokens``), and neither ids nor texts leave the task.  One narrow stage,
no shuffle; memory is bounded by the text, the slice and the chunk cache.

Defined results: a null text counts as empty; an empty table gives an empty
table; repeated rows are counted alike; other columns are carried, and those
named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import carried, restored
from .tokens import encoder
from .words import slices
from .workers import lean

SLICE_BYTES = 2 << 20


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for whole in batches:
            for batch in slices(whole, 0, SLICE_BYTES):
                lengths = tokens.count(batch.column(0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.asarray(lengths, np.int64))], ["text", "rest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``)."""
    base = docs.select(F.col(f"`{text_col}`").alias("text"), carried(docs, text_col).alias("rest"))
    counted = base.mapInArrow(lean(_count(tokenizer_path), tokens=True), f"text string, rest {base.schema['rest'].dataType.simpleString()}, n_tokens long")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    made = {text_col: F.col("text"), "n_bytes": size, "n_tokens": F.col("n_tokens"), "over_limit": F.col("n_tokens") > limit}
    return restored(counted, docs.columns, made)
