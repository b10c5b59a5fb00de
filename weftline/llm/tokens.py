"""Text sizes in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), path: str = TOKENIZER) -> DataFrame:
    """``id_col``, the string columns ``keep`` and n_tokens of each row; null texts have size null."""
    schema = f"{id_col} bigint" + "".join(f", {k} string" for k in keep) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [None if t is None else len(enc.encode_ordinary(t)) for t in b["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in (id_col, *keep)), pa.array(n, pa.int64())], names=[id_col, *keep, "n_tokens"])

    return spread(df.select(F.col(id_col).cast("bigint").alias(id_col), *[F.col(k).cast("string").alias(k) for k in keep], F.col(text_col).alias("_text"))).mapInArrow(run, schema)
