"""Running token counts of keyed text streams with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mergeloom.functions.columns import Tokenizer
from mergeloom.operators.incremental import Appender

STATE = "data binary, last array<int>, counts array<bigint>, dropped bigint"


def stream_append_counts(tok: Tokenizer, stream: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, n_bytes, n_tokens) of a key's concatenated texts after each batch that has rows of it.

    Within a batch a key's rows are taken by `order`; null texts add nothing.  A key's
    state is the last few `max_len` bytes with their counts, however long it gets.
    """
    shared = tok._shared

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        grown = Appender.restore(shared.value, state.get) if state.exists else Appender(shared.value)
        rows = pd.concat(list(batches)).sort_values("_order", kind="stable")
        for t in rows["_text"]:
            if isinstance(t, str):
                grown.extend(t.encode())
        data, last, counts, dropped = grown.state()
        state.update((data, last, counts, dropped))
        yield pd.DataFrame({key: [keys[0]], "n_bytes": [len(grown)], "n_tokens": [grown.token_count]})

    kind = dict(stream.dtypes)[key]
    rows = stream.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(text).cast("string").alias("_text"))
    return rows.groupBy("_key").applyInPandasWithState(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint", STATE, "update", GroupStateTimeout.NoTimeout)


def stream_token_counts(tok: Tokenizer, stream: DataFrame, time: str, text: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, n_texts, n_tokens) by event time; rows later than the watermark are dropped."""
    counted = stream.withColumn("_n", tok.count(text)).withWatermark(time, late)
    return counted.groupBy(F.window(time, window).alias("window")).agg(F.count("*").alias("n_texts"), F.sum("_n").alias("n_tokens"))
