"""Shared pieces of the training-text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.session import cut, ensure_checkpoint_dir, table  # noqa: F401

#: Rows whose texts are worked on together in numpy; bounds the memory of a Python worker.
CHARS_AT_ONCE = 1_500_000


def batches_by_chars(texts: list[str], limit: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts that hold about `limit` code points together; a longer text stands alone."""
    a = size = 0
    for b, t in enumerate(texts):
        n = len(t)
        if b > a and size + n > limit:
            yield a, b
            a, size = b, 0
        size += n
    if len(texts) > a:
        yield a, len(texts)


def code_points(texts: list[str], gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts one after the other, with the offsets of the texts (one more than texts).

    gap: so many zeros follow each text, so that windows never reach over two texts unseen.
    """
    sep = "\0" * gap
    joined = sep.join(texts) + sep
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + gap for t in texts), dtype=np.int64, count=len(texts)))
    return points, np.concatenate([np.zeros(1, np.int64), ends])


def arrow_map(df: DataFrame, f: Callable[[dict[str, list]], Iterable[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow with columns as Python lists in and out; f may give any number of results for a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)}
            for out in f(columns):
                arrays = [pa.array(out[field.name], type=field.type) for field in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def one_per_key(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Repeated rows of a key count once: rows equal in key and columns are merged, the least values win a tie."""
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in columns])
