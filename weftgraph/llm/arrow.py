"""Functions of texts that run in Python workers; every other column stays in the JVM and comes back as it went."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

#: Texts handled at a time, so that what is made of them stays small whatever a batch holds.
AT_ONCE = 256


def per_text(returns: str, make: Callable[[], Callable[[list], pa.Array]]) -> Callable:
    """A column function of one column of texts (or bytes), which may be null. ``make`` is called once for each task and
    gives a function from a list of values to an Arrow array of the type that ``returns`` names."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        convert = make()
        for batch in batches:
            yield pa.concat_arrays([convert(batch.slice(i, AT_ONCE).to_pylist()) for i in range(0, len(batch), AT_ONCE)] or [convert([])])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)


def structs(**columns: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))
