"""Token counts of whole texts by rank-synchronous merging (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellweave.llm import bpe
from cellweave.llm.common import column, per_process, slices, text_bytes


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    ``tokenizer`` is a byte-level BPE file in the JSON form of the ``tokenizers`` library, readable on the workers.
    Begin, end and padding ids are not counted; a special string inside a text counts as its one id, the library's
    default. Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids stay rows of their own; other
    columns are not read. No shuffle; a task holds one slice of about 8 MB of texts (or one longer text) at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = per_process(f"vocabulary {tokenizer}", lambda: bpe.load(tokenizer))
        known = per_process(f"pieces {tokenizer}", bpe.Pieces)
        for batch in slices(batches, text_col):
            texts = column(batch, text_col)
            n = bpe.token_counts(vocab, texts, known)
            n_bytes = np.diff(text_bytes(texts)[1])
            yield pa.RecordBatch.from_arrays(
                [column(batch, id_col), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
