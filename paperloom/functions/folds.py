"""Ordered folds of a key's rows into one text or digest, without gathering them into an array."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of finished texts handed on at once.
FLUSH = 16 << 20


def ordered_fold(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, *, separator: str = "", digest: tuple[str, str] | None = None) -> DataFrame:
    """`by`, `name`, n, used: the values of each key in `order` (nulls first, equal places by value), with the separator between them.

    With `digest`, `name` is the lowercase sha256 of the text between the two strings of `digest`, and no text is ever
    held whole: rows come sorted from the shuffle, which spills, and are folded as they pass. Without it a task holds the
    text of one key. Null values add nothing; `n` counts the rows of a key, `used` its values.
    """
    d = df.select(*by, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], value.cast("string").alias("_v"))
    d = d.repartition(*by).sortWithinPartitions(*by, *[f"_o{i}" for i in range(len(order))], "_v").select(*by, "_v")
    keys = d.select(*by).schema.fields
    width, sep = len(by), separator.encode()
    head, tail = (x.encode() for x in digest or ("", ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size, n, used, key, parts = 0, 0, 0, None, []
        state = sha256(head)

        def close() -> None:
            nonlocal size, n, used, parts, state
            if digest is None:
                text = "".join(parts)
            else:
                state.update(tail)
                text = state.hexdigest()
            done.append((*key, text, n, used))
            size, n, used, parts, state = size + len(text), 0, 0, [], sha256(head)

        def flush() -> pa.RecordBatch:
            nonlocal done, size
            types = [*(to_arrow_type(f.dataType) for f in keys), pa.string(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=[*by, name, "n", "used"])
            done, size = [], 0
            return out

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(width)), b.column(width), strict=True):
                if n and row[:-1] != key:
                    close()
                    if size > FLUSH:
                        yield flush()
                key, v, n = row[:-1], row[-1].as_py(), n + 1
                if v is None:
                    continue
                if digest is None:
                    parts += [separator, v] if used else [v]
                else:
                    state.update(sep * bool(used) + v.encode())
                used += 1
        if n:
            close()
        yield flush()

    more = [T.StructField(name, T.StringType()), T.StructField("n", T.LongType()), T.StructField("used", T.LongType())]
    return d.mapInArrow(run, T.StructType([*keys, *more]))
