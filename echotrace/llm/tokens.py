"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

#: A tokenizer file readable by the tokenizers library; the environment variable or an argument names another.
TOKENIZER = os.environ.get("ECHOTRACE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def with_size(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Add `n_tokens`, the number of tokens of the whole text; null and empty texts have 0. The tokenizer is shipped to the executors, who need no file of their own."""
    sc, name = docs.sparkSession.sparkContext, os.path.basename(tokenizer)
    if (sc.applicationId, tokenizer) not in _SENT:
        _SENT.add((sc.applicationId, tokenizer))
        sc.addFile(tokenizer)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if tokenizer not in _LOADED:
            t = Tokenizer.from_file(SparkFiles.get(name))
            t.encode_special_tokens = True
            _LOADED[tokenizer] = t
        out = []
        for lo in range(0, len(texts), 64):
            out += [len(e.ids) for e in _LOADED[tokenizer].encode_batch_fast([t or "" for t in texts.iloc[lo : lo + 64]], add_special_tokens=False)]
        return pd.Series(out, index=texts.index, dtype="int64")

    return docs.withColumn("n_tokens", count(text))


_LOADED: dict = {}
_SENT: set = set()
