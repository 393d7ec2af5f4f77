"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.bpe import Encoder, Vocabulary
from factweave.plans.spread import spread

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of ids after which an output batch ends.
BATCH_BYTES = 8 << 20

_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str, folder: str = TOKENIZERS) -> Encoder:
    """The encoder of ``folder/vocabulary.tiktoken``; one per Python worker."""
    path = f"{folder}/{vocabulary}.tiktoken"
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(path), PATTERN)
    return _encoders[path]


def _encode_udf(vocabulary: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, folder)

        def batch(keys, parts):
            ends = np.cumsum([0, *map(len, parts)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys) if len(keys) > 1 else keys[0], ids], ["key", "ids"])

        for b in batches:
            keys, texts = b.column(0), b.column(1)
            start, size, parts = 0, 0, []
            for i in range(b.num_rows):
                parts.append(encode(texts[i].as_py()))
                size += len(parts[-1])
                if size >= BATCH_BYTES:
                    yield batch([keys.slice(start, i + 1 - start)], parts)
                    start, size, parts = i + 1, 0, []
            if parts:
                yield batch([keys.slice(start)], parts)

    return run


def encode(documents: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, ids`` of each row, without special tokens; an empty list for an empty or a null text.

    Whole texts are encoded, of any length; rows with equal or null keys stay separate rows; other columns are ignored.
    Nothing is shuffled, unless the table has fewer partitions than there are cores: a task encodes the rows it reads.
    """
    kind = dict(documents.dtypes)[key]
    rows = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return rows.mapInArrow(_encode_udf(vocabulary, folder), f"key {kind}, ids array<int>").withColumnRenamed("key", key)
