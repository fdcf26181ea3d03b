"""Long texts cut into chunks that a model with a bounded input can take, and what it returns put together again."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of chunks that are handed on at once, about.
BATCH_CHARS = 1 << 20

Spans = Callable[[str], list[tuple[int, int]]]


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each run of letters, digits and underscore, in characters."""
    return [m.span() for m in re.finditer(r"\w+", text)]


def chunk_texts(df: DataFrame, doc: str, text: str, max_tokens: int, spans: Spans = word_spans) -> DataFrame:
    """(doc, chunk, start, end, n_tokens, chunk_text): each text in chunks of at most max_tokens of the caller's tokens.

    spans gives the tokens' places in a text. A chunk reaches from its first token to the end of its last; a text of
    max_tokens or fewer, an empty or null one too, is one chunk as it stands. Chunks count from 0.
    """
    kind = df.schema[doc].dataType.simpleString()

    def packed(ids: pa.Array, rows: list[list]) -> pa.RecordBatch:
        own, *numbers, texts = rows
        return pa.RecordBatch.from_arrays([ids.take(pa.array(own, pa.int64())), *[pa.array(v, pa.int32()) for v in numbers], pa.array(texts, pa.string())], names=["d", "chunk", "start", "end", "n_tokens", "chunk_text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0), batch.column(1)
            rows: list[list] = [[] for _ in range(6)]
            held = 0
            for i in range(batch.num_rows):  # one text at a time, and chunks go on as they come
                value = values[i].as_py() or ""
                found = spans(value)
                whole = len(found) <= max_tokens
                for k in range(max(1, -(-len(found) // max_tokens))):
                    part = found[k * max_tokens : (k + 1) * max_tokens]
                    lo, hi = (0, len(value)) if whole else (part[0][0], part[-1][1])
                    for to, v in zip(rows, (i, k, lo, hi, len(part), value[lo:hi]), strict=True):
                        to.append(v)
                    held += hi - lo
                    if held >= BATCH_CHARS:
                        yield packed(ids, rows)
                        rows, held = [[] for _ in range(6)], 0
            yield packed(ids, rows)

    out = df.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInArrow(cut, f"d {kind}, chunk int, start int, end int, n_tokens int, chunk_text string")
    return out.withColumnRenamed("d", doc)
