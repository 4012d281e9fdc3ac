"""Token counts with a tokenizer's vocabulary file, batch by batch in Python; without one see text.token_estimate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _spans(vocabulary: str, texts: pd.Series) -> list[list[tuple[int, int]]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return [e.offsets for e in t.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)]


def counter(vocabulary: str) -> Callable[[Column], Column]:
    """A function of a text column to its number of tokens; null counts as empty."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([len(x) for x in _spans(vocabulary, b)], dtype="int64")

    return count


def truncated(vocabulary: str, most: int) -> Callable[[Column], Column]:
    """A function of a text column to the text of its first `most` tokens; null stays null."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            ends = [len(t or "") if len(x) <= most else x[most - 1][1] if most else 0 for t, x in zip(b, _spans(vocabulary, b), strict=True)]
            yield pd.Series([None if t is None else t[:e] for t, e in zip(b, ends, strict=True)], dtype=object)

    return cut
