"""Token counts by a public tokenizer. The folder of the vocabulary files is a parameter; nothing is copied or trained."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

VOCABULARIES = os.environ.get("TRACELAKE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SLICE = 100_000


@lru_cache(maxsize=4)
def encoding(folder: str = VOCABULARIES, name: str = VOCABULARY):
    """The encoder of one rank file; loaded once per worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_files", f"{folder}/__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, folder: str = VOCABULARIES, name: str = VOCABULARY) -> int:
    """Tokens of a text; lone surrogates, which no encoder takes, count as the replacement character."""
    enc = encoding(folder, name)
    return len(enc.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")))


def sized(docs: DataFrame, key: str = "doc_id", source: str | None = None, text: str = "text", folder: str = VOCABULARIES, name: str = VOCABULARY) -> DataFrame:
    """(key, source, text_hash, n_tokens): 128-bit hash and token count of every text; NULL texts count 0 tokens.

    Row-local; the texts themselves end here and are never shuffled.
    """
    schema = pa.schema([("key", pa.int64()), ("source", pa.string()), ("text_hash", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.array([count_tokens(t, folder, name) for t in texts], dtype=np.int64)
            hashes = pa.array([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
            sources = batch.column(2) if source else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), sources.cast(pa.string()), hashes, pa.array(n)], schema=schema)

    cols = [key, text, *([source] if source else [])]
    return docs.select(*cols).mapInArrow(run, "key bigint, source string, text_hash binary, n_tokens bigint")
