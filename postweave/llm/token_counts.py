"""Tokens of every text, counted by rank-synchronous merging of whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.llm.bpe import tokenizer, vocabulary
from postweave.llm.common import prepare
from postweave.llm.ragged import portions

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048


def counted(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``docs``.

    ``path`` is the vocabulary file's place on every machine, the public one if
    not given. No begin, end or added special tokens; special strings inside a
    text count as the library's default has it. Null texts have no bytes and no
    tokens, a null id stays null, repeated rows are counted each. Columns other
    than doc_id and text are not read. Texts are worked on in portions of 16 MB,
    a longer one alone.
    """
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path or vocabulary(VOCABULARY))
        for batch in batches:
            texts = batch.column(1)
            n = [bpe.count(part) for part in portions(texts)]
            n = pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, n, pc.greater(n, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
