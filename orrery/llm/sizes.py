"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rank file of the vocabulary, in the tiktoken format; a parameter of every operator that counts tokens.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(ranks: str = RANKS):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_counts(texts: DataFrame, text: str = "text", out: str = "n_tokens", ranks: str = RANKS) -> DataFrame:
    """``texts`` without ``text`` and with ``out`` BIGINT; null and empty texts have 0 tokens.

    Strings of special tokens are ordinary text. A column called ``out`` is replaced. Texts stay in their partition.
    """
    kept = texts.select(*[c for c in texts.columns if c not in (text, out)], text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != text), f"`{out}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], out])

    return kept.mapInArrow(run, schema)
