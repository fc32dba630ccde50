"""Texts as tokens of a public tokenizer."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from twinledger.runtime import spread


@dataclass(frozen=True)
class Tokenizer:
    """A file of byte-pair ranks (base64 token, rank) and the pattern that splits a text before merging."""

    path: str
    pattern: str

    @staticmethod
    def default() -> Tokenizer:
        import public_tokenizers

        return Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def read(self) -> bytes:
        with open(self.path, "rb") as f:
            return f.read()


def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def _each(ranks, pattern: str, as_list: bool):
    def run(batches):
        encode = _encoder(ranks.value, pattern).encode_ordinary
        for batch in batches:
            found = [encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            n = pa.array([len(x) for x in found], pa.int64())
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = list(batch.schema.names[:-1])
            if as_list:
                yield pa.RecordBatch.from_arrays([*own, n, pa.array(found, pa.list_(pa.int32()))], [*names, "n", "tokens"])
            else:
                yield pa.RecordBatch.from_arrays([*own, n], [*names, "n"])

    return run


def tokenised(documents: DataFrame, keep: list[str], text: str = "text", tokenizer: Tokenizer | None = None, as_list: bool = False, scan: bool = True) -> DataFrame:
    """The kept columns, n (tokens of the whole text) and, with as_list, the tokens. Null texts are left out; an empty one has 0 tokens.

    The tokenizer's file, under a megabyte, is broadcast, so executors need not have it. documents are a scan (see runtime.spread), or with
    scan=False any frame, whose partitions and order are kept.
    """
    tokenizer = tokenizer or Tokenizer.default()
    ranks = documents.sparkSession.sparkContext.broadcast(tokenizer.read())
    found = documents.filter(documents[text].isNotNull()).select(*keep, text)
    found = spread(found) if scan else found
    schema = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep) + ", n long" + (", tokens array<int>" if as_list else "")
    return found.mapInArrow(_each(ranks, tokenizer.pattern, as_list), schema)
