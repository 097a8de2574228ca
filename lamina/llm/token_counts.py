"""Token counts of whole texts.

Batches of texts go to the tokenizer's library inside an Arrow function that returns lengths only. Each batch holds
about the same number of bytes, whatever the number of rows, and a long text is cut where no token can cross.

A null text counts as empty: 0 bytes, 0 tokens. A null id is passed on. Repeated rows are counted each. Columns other
than the id and the text are ignored, whatever their names. No rows give no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import ids_and_text

#: A space or line feed between two letters: the byte-level pattern starts a new match there.
_BYTE_LEVEL_CUT = re.compile(r"(?<=[^\W\d_])(?=[ \n][^\W\d_])")
#: A lone space between two letters, dropped by the cut as the library puts one before each text.
_PIECE_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def cut(text: str, size: int, pattern: re.Pattern) -> list[str]:
    """Parts of at least ``size`` characters (but the last) whose token counts add up to the text's."""
    if len(text) <= size:
        return [text]
    parts, at = [], 0
    while len(text) - at > size and (m := pattern.search(text, at + size)):
        parts.append(text[at : m.start()])
        at = m.end()
    return [*parts, text[at:]]


@lru_cache(maxsize=4)
def counter(path: str) -> tuple[Callable[[list[str]], list[int]], re.Pattern]:
    """The library's own counts for a list of texts, and where its texts may be cut; loaded once a worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], _PIECE_CUT
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core belongs to a task
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], _BYTE_LEVEL_CUT


def _counts(texts: list[str], path: str, batch_bytes: int, part_chars: int) -> list[int]:
    count, pattern = counter(path)
    totals, parts, owners, held = [0] * len(texts), [], [], 0

    def settle() -> None:
        nonlocal held
        for i, n in zip(owners, count(parts), strict=True):
            totals[i] += n
        parts.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        for part in cut(text, part_chars, pattern) if text else ():
            parts.append(part)
            owners.append(i)
            held += len(part)
            if held >= batch_bytes:
                settle()
    if parts:
        settle()
    return totals


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, batch_bytes: int = 1 << 18, part_chars: int = 1 << 15) -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` as the library of the vocabulary file ``tokenizer`` gives
    them without added tokens, and ``over_limit``. There is no shuffle."""
    plain = ids_and_text(docs, id_col, text_col)
    schema = T.StructType([plain.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in batches:
            texts = b.column(1)
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            n_tokens = pa.array(_counts(texts.to_pylist(), tokenizer, batch_bytes, part_chars), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, n_tokens], names=[id_col, "n_bytes", "n_tokens"])

    return plain.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
