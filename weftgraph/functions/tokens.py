"""Token counts by a byte-pair vocabulary, whose file is the caller's."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how a text is cut before its pieces are merged.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str, pieces: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("own", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(text: Column, path: str, pieces: str = PIECES) -> Column:
    """How many tokens a text has under the ranks in ``path`` (``.tiktoken``: a token in base 64 and its rank a line).

    The file must be at that path on every executor, as it is in an image or by ``addFile``.
    Names of special tokens in a text are ordinary text. Null has no tokens.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(path, pieces)
        return texts.fillna("").map(lambda t: len(encoding.encode_ordinary(t)))

    return count(text)
