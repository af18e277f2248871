"""Arrow batches through Python functions, the only way Python code runs on rows here."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from holdfast.operators.rows import balanced

#: Bytes of a batch that are turned into Python objects at once.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of some ``limit`` bytes, of one row at least."""
    rows = max(1, batch.num_rows * limit // max(1, batch.nbytes))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def map_columns(df: DataFrame, func: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``func(*columns as lists)`` yields output tuples; it is called for slices of bounded bytes of each Arrow batch.

    A plain scan in fewer partitions than there are cores is spread over them first.
    """
    from pyspark.sql.types import _parse_datatype_string

    kind: StructType = _parse_datatype_string(schema)  # type: ignore[assignment]
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = list(func(*[c.to_pylist() for c in part.columns]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(col), type=f.type) for col, f in zip(zip(*rows), arrow)], schema=arrow
                    )

    return balanced(df).mapInArrow(run, kind)


def common_words(words: DataFrame, most: int = 1_000_000) -> frozenset[str]:
    """The words of ``(lang, word)``, a given list of a few hundred rows; more than ``most`` raise."""
    got = words.where("word IS NOT NULL").select("word").distinct().limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} common words")
    return frozenset(r["word"] for r in got)
