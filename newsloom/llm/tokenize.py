"""Encoding of a corpus by a public tokenizer (problem 8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bpe_automaton import TOKENIZERS, automaton


def ids_udf(tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = automaton(tokenizer, folder).encode
        rows = [encode(t) for t in texts.to_pylist()]
        ends = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=ends[1:])
        flat = np.fromiter((i for r in rows for i in r), np.int32, int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return ids


def count_udf(tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        encode = automaton(tokenizer, folder).encode
        return pa.array([len(encode(t)) for t in texts.to_pylist()], pa.int64())

    return count


def token_ids(text: Column | str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Ids of ``text`` without special tokens; their strings in a text are ordinary text.

    Null and empty texts have the empty list. Lone surrogates become ``?``.
    """
    return ids_udf(tokenizer, folder)(text)


def token_count(text: Column | str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Number of ids of ``text``; 0 for null and empty texts."""
    return count_udf(tokenizer, folder)(text)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``id_col`` and ``ids`` of every row, repeated rows included; no shuffle, one pass over two columns."""
    return docs.select(F.col(id_col), token_ids(F.col(text_col), tokenizer, folder).alias("ids"))


def decode_udf(tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        back = automaton(tokenizer, folder).decode
        return pa.array([None if r is None else back(r) for r in ids.to_pylist()], pa.string())

    return decode
