"""Chunk streams: running state per image. An extension; image data chunks are independent, so they can be followed.

State is a few numbers per image: the header's budget, the bytes and chunks so far, whether the end has come.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import container as K

cloudpickle.register_pickle_by_value(sys.modules[__name__])
OUT = "img_id bigint, chunks bigint, tiles bigint, bytes bigint, budget bigint, ended boolean"
STATE = "chunks bigint, tiles bigint, bytes bigint, budget bigint, ended boolean"


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One update per image and micro-batch."""
    chunks, tiles, size, budget, ended = state.get if state.exists else (0, 0, 0, 0, False)
    for b in batches:
        for kind, data in zip(b["type"], b["data"], strict=True):
            chunks += 1
            if kind == K.IHDR:
                budget = K.Header.parse(bytes(data)).budget
            elif kind == K.IDAT:
                tiles, size = tiles + 1, size + len(data)
            elif kind == K.IEND:
                ended = True
    state.update((chunks, tiles, size, budget, ended))
    yield pd.DataFrame([(key[0], chunks, tiles, size, budget, ended)], columns=[c.split()[0] for c in OUT.split(", ")])


def progress(stream: DataFrame) -> DataFrame:
    """A stream of chunks (img_id, type, data) as a stream of progress rows per image (update mode)."""
    return stream.select("img_id", "type", "data").groupBy("img_id").applyInPandasWithState(advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
