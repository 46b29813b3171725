"""Running sums within keys over sorted data, with no key bound to one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def running(df: DataFrame, key: str, ranges: Sequence[Column], order: Sequence[Column], terms: Callable[[pa.RecordBatch], Sequence[np.ndarray]], sums: Mapping[str, int | None], name: str) -> DataFrame:
    """``df`` with two running sums for each name of ``sums``, over the rows of its key in order: under that name with the
    row's own term, as ``before <name>`` without it.

    ``key`` is a column of longs without nulls. Rows are dealt out by ranges of ``ranges``, which begin with the key, and
    sorted within by ``order``, which refines them; so a key with very many rows spans tasks. ``terms`` makes the arrays of
    terms from a batch; where ``sums`` gives a modulus for a name, its terms are below that and sums are taken by it.

    Each task sums what it has; of every task the sums of its first and its last key go to the driver (a row a task), which
    carries them on; a second pass adds what is carried to the rows of each task's first key.
    """
    made = [n for s in sums for n in (s, f"before {s}")]
    names = [*df.columns, *made, "_slice", "_nth", "_open"]
    moduli = list(sums.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first, last, nth = TaskContext.get().partitionId(), None, None, 0
        carried = [0] * len(moduli)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            if first is None:
                first = last = keys[0]
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[heads, n])
            columns = []
            for i, (own, modulus) in enumerate(zip(terms(batch), moduli, strict=True)):
                own = own.astype(np.int64)
                total = np.cumsum(own)
                total -= np.repeat(total[heads] - own[heads], sizes)
                if keys[0] == last:
                    total[: sizes[0]] += carried[i]
                if modulus:
                    total %= modulus
                carried[i] = int(total[-1])
                columns += [pa.array(total), pa.array((total - own) % modulus if modulus else total - own)]
            last = keys[-1]
            marks = [pa.array(np.full(n, task, np.int64)), pa.array(np.arange(nth, nth + n)), pa.array(keys == first)]
            nth += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, *marks], names)

    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *[f"`{s}` long" for s in made], "_slice long, _nth long, _open boolean"])
    dealt = stored(df.repartitionByRange(*ranges).sortWithinPartitions(*order).mapInArrow(run, kinds), f"{name}-dealt")
    at = F.struct(*[F.col(f"`{s}`") for s in sums])
    slices = dealt.groupBy("_slice").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(at, F.when(F.col("_open"), F.col("_nth"))).alias("head"), F.max_by(at, "_nth").alias("tail")).orderBy("_slice").collect()
    carries, before, so_far = [], None, [0] * len(moduli)
    for s in slices:
        carry = so_far if s["first"] == before else [0] * len(moduli)
        if any(carry):
            carries.append((s["_slice"], True, *carry))
        so_far = [a + (b if s["first"] == s["last"] else 0) for a, b in zip(s["tail"], carry)]
        so_far = [x % m if m else x for x, m in zip(so_far, moduli)]
        before = s["last"]
    carried = df.sparkSession.createDataFrame(carries, ", ".join(["_slice long, _open boolean", *[f"`+{s}` long" for s in sums]]))
    plus = {n: F.col(f"`{n}`") + F.coalesce(F.col(f"`+{s}`"), F.lit(0)) for s in sums for n in (s, f"before {s}")}
    whole = [(plus[n] % m if m else plus[n]).alias(n) for s, m in sums.items() for n in (s, f"before {s}")]
    # a row for each task at most
    joined = dealt.join(F.broadcast(carried), ["_slice", "_open"], "left")
    out = stored(joined.select(*df.columns, *whole), name)
    discard(dealt)
    return out
