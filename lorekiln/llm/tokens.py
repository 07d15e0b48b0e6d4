"""Token counts of a public tokenizer, exact, with a bounded cache over space-divided units."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER_DIR = os.environ.get("LOREKILN_TOKENIZERS", "/opt/tokenizers")
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
CACHE_ENTRIES = 300_000
#: A blank beside other white space, or at an end.
RUN_OF_SPACE = re.compile(r" \s|[^\S ] |^ | $")

_COUNTERS: dict[str, "Counter"] = {}


class Counter(dict):
    """Counts tokens of a text; a dict from unit to its number of tokens.

    No piece of the pattern reaches over a single blank into the next word (the blank opens the next piece), so
    a text without runs of white space is the sum of its units, each with its leading blank. Others are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, unit: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        n = self[unit] = len(self.encoder.encode_ordinary(" " + unit))
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if RUN_OF_SPACE.search(text):
            return len(self.encoder.encode_ordinary(text))
        units = text.split(" ")
        return len(self.encoder.encode_ordinary(units[0])) + sum(map(self.__getitem__, units[1:]))


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def with_token_count(df: DataFrame, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None, tokenizer_dir: str = TOKENIZER_DIR, rank_file: str = RANK_FILE) -> DataFrame:
    """Adds the token count of ``text`` (null counts 0) and keeps only ``keep`` beside it, so that texts aren't sent back.

    One Arrow pass, no shuffle. The tokenizer is read from ``tokenizer_dir`` on each executor.
    """
    path = os.path.join(tokenizer_dir, rank_file)
    kept = [c for c in (keep if keep is not None else df.columns) if c != out]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            counts = [c.count(x) for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            cols = [b.column(b.schema.get_field_index(k)) for k in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int32())], names=[*kept, out])

    need = list(dict.fromkeys([*kept, text]))
    return df.select(*[F.col(f"`{c}`") for c in need]).mapInArrow(run, schema)
