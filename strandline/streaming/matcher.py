"""Streams: records as they arrive, and exact search in texts that arrive in chunks.

Per-record operators are stateless and apply to a streaming DataFrame as they are. A text that is cut into chunks
across micro-batches needs its last symbols kept: as state, per text, the last ``m - 1`` symbols and the offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.sources import text


def stream_fasta(spark: SparkSession, path: str) -> DataFrame:
    return text.read_fasta(spark, path, streaming=True)


def find_in_chunks(df: DataFrame, key: str, order: str, chunk: str, pattern: str) -> DataFrame:
    """(key, pos): places of a pattern in texts that arrive in chunks, those over the border of two chunks included.

    Within a micro-batch chunks are ordered by ``order``; across batches by arrival.
    """
    if not pattern:
        raise ValueError("the pattern must not be empty")
    m = len(pattern)
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, offset = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for c in rows[chunk].dropna():
            text_ = tail + c
            at = text_.find(pattern)
            while at >= 0:
                out.append(offset + at)
                at = text_.find(pattern, at + 1)
            keep = min(m - 1, len(text_))
            offset += len(text_) - keep
            tail = text_[len(text_) - keep :]
        state.update((tail, offset))
        yield pd.DataFrame({key: [k[0]] * len(out), "pos": pd.Series(out, dtype="int64")})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, pos bigint", "tail string, offset bigint", "append", GroupStateTimeout.NoTimeout)
