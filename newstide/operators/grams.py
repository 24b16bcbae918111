"""Statistics over all n-grams of up to a few words, of which a shuffle carries one row a word: n-grams that start with the same words meet where these do."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def starts(rows: DataFrame, words: str, most: int) -> DataFrame:
    """``rows`` (less ``words``, an array) with a row a word: w1 to w ``most``, it and those after it (null after the end), and n1 to
    n ``most``, how often the array has the n-gram that starts there; 0 where there is none or the array has had it before."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kept = rows.drop(words)
    columns = kept.columns
    size = range(1, most + 1)
    schema = StructType([*kept.schema, *[StructField(f"w{k}", StringType()) for k in size], *[StructField(f"n{k}", LongType()) for k in size]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            lists = batch.column(words)
            length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            word = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), length)
            left = np.repeat(np.cumsum(length), length) - np.arange(len(word))  # words from here to the end
            gram, texts, counts = row, [], []
            for k in size:
                at = np.flatnonzero(left >= k)
                texts.append(flat.take(pa.array(np.arange(k - 1, k - 1 + len(word)), mask=left < k)))
                # n-grams of a row by number: the shorter one's number and the next word's
                _, first, number, often = np.unique(gram[at] * (len(word) + 1) + word[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
                n = np.zeros(len(word), np.int64)
                n[at[first]] = often
                counts.append(pa.array(n))
                gram = np.zeros(len(word), np.int64)
                gram[at] = number
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in columns], *texts, *counts], schema=arrow)

    return rows.select(*columns, words).mapInArrow(run, schema)


def weighed(rows: DataFrame, words: str, most: int, weight: Callable[[Column, Column], Column]) -> DataFrame:
    """(columns of ``rows`` but ``words``, grams, squares, top): how many n-grams of 2 to ``most`` words start at each word for the first time in its
    array, and the sum of the squares and the largest of their weights, of the n-gram's number in the array and of the number of arrays that have it.

    Words are dealt by themselves and the next, sorted once; n-grams are then runs.
    """
    size = range(2, most + 1)
    texts = [f"w{k}" for k in range(1, most + 1)]
    x = starts(rows, words, most).where("w2 is not null").drop("n1").repartition("w1", "w2").sortWithinPartitions(*texts)
    x = x.withColumns({f"df{k}": F.count_if(F.col(f"n{k}") > 0).over(Window.partitionBy(*texts[:k])) for k in size})
    had = [F.col(f"n{k}") > 0 for k in size]
    x = x.withColumns({f"x{k}": F.when(h, weight(F.col(f"n{k}"), F.col(f"df{k}"))).otherwise(0.0) for k, h in zip(size, had, strict=True)})
    squares = sum((F.col(f"x{k}") * F.col(f"x{k}") for k in size), F.lit(0.0))
    top = F.array_max(F.array(*[F.when(h, F.col(f"x{k}")) for k, h in zip(size, had, strict=True)]))
    return x.select(*[c for c in rows.columns if c != words], sum((h.cast("long") for h in had), F.lit(0)).alias("grams"), squares.alias("squares"), top.alias("top"))
