"""Encoding and decoding with a SentencePiece model file; the library is needed only when a column is evaluated."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(text: Column, model: str) -> Column:
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        p = _processor(model)
        return pd.Series([None if t is None else p.encode(t, num_threads=1) for t in texts])

    return run(text)


def pieces(text: Column, model: str) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        p = _processor(model)
        return pd.Series([None if t is None else p.encode(t, out_type=str, num_threads=1) for t in texts])

    return run(text)


def decode(ids: Column, model: str) -> Column:
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        p = _processor(model)
        return pd.Series([None if r is None else p.decode([int(i) for i in r]) for r in rows])

    return run(ids)


def special_ids(model: str) -> dict[str, int]:
    p = _processor(model)
    return {"unk": p.unk_id(), "bos": p.bos_id(), "eos": p.eos_id(), "pad": p.pad_id()}


def vocabulary(spark, model: str) -> DataFrame:
    """id and piece of every entry; a vocabulary is bounded, so it can be broadcast for look-ups."""
    p = _processor(model)
    return spark.createDataFrame([(i, p.id_to_piece(i)) for i in range(p.get_piece_size())], "id int, piece string")


def looked_up(df: DataFrame, vocab: DataFrame, key: str, to: str, unknown, bounded: bool = True) -> DataFrame:
    """``df`` with ``to`` from the vocabulary by ``key``, or ``unknown``; only a vocabulary of ``bounded`` size is broadcast."""
    return df.join(F.broadcast(vocab) if bounded else vocab, key, "left").withColumn(to, F.coalesce(F.col(to), F.lit(unknown)))
