"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files and the file used; both are parameters.
TOKENIZER_DIR, TOKENIZER = os.environ.get("TRACELODE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(folder: str, name: str):
    """A function from a list of texts to their sizes, made once a worker process."""
    path = os.path.join(folder, name)
    if name.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]


def _count(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = encoder(folder, name)([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size, pa.int64())], names=[*b.schema.names[:-1], "tokens"])

    return run


def token_sizes(documents: DataFrame, *keep: str, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``doc_id, *keep, tokens``: whole texts are encoded; NULL and empty texts have 0 tokens."""
    x = documents.select("doc_id", *keep, F.col("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-1]) + ", tokens bigint"
    return x.mapInArrow(_count(folder, name), schema)
