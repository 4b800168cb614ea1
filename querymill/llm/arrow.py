"""Columns that a task works out in Arrow batches, beside whatever other columns there are."""

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def with_columns(df: DataFrame, source: Sequence[str], added: Sequence[tuple[str, str]], make: Callable, without: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``added`` (name, type) columns, which ``make`` works out of the ``source`` columns of each batch.

    ``make(batches)`` takes an iterator of lists of Arrow arrays and yields a list of Arrow arrays for each. Own columns of the added names are replaced,
    those of ``without`` left out of the result. Columns are told apart by place, so any names do; of several source columns
    of one name the first is read.
    """
    names = [n for n, _ in added]
    kept = [i for i, n in enumerate(df.columns) if n not in names and n not in without]
    places = [df.columns.index(n) for n in source]
    wanted = list(dict.fromkeys([*kept, *places]))
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    fields = plain.schema.fields
    schema = StructType([fields[i] for i in kept])
    for i, (_, kind) in enumerate(added):
        schema = StructType([*schema.fields, *StructType.fromDDL(f"a{i} {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def inputs():
            for batch in batches:
                held.append(batch)
                yield [batch.column(f"c{i}") for i in places]

        for arrays in make(inputs()):
            batch = held.pop(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(f"c{i}") for i in kept], *arrays], names=schema.names)

    out = plain.select(*[f"c{i}" for i in wanted]).mapInArrow(run, schema)
    return out.toDF(*[df.columns[i] for i in kept], *names)

