"""Archives of numeric arrays (NPZ) as tables.

Archives are read through Spark's binary files, so any file system that Spark
reaches will do, and taken apart in the tasks, one archive each. They are models
or exports of models: writing gathers one archive on the driver behind a check
of its bytes.
"""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, name string, row int, values array<double>"
#: Rows of an array that are handed to Spark at once, and bytes an archive may have to be written.
SLICE_ROWS, ARCHIVE_BYTES = 4096, 256 << 20


def read_arrays(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """(path, name, row, values) of the arrays of every archive under ``path``.

    A matrix has a row per line, a vector or a single number one row, a higher
    array is flattened behind its first axis, an empty one has none. Without ``names`` all numeric
    arrays are read; arrays of objects are never unpickled, and raise if named.
    """
    wanted = None if names is None else set(names)

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with np.load(io.BytesIO(content.as_buffer()), allow_pickle=False) as archive:
                    for name in archive.files:
                        if wanted is not None and name not in wanted:
                            continue
                        try:
                            held = archive[name]
                        except ValueError:
                            if wanted is None:
                                continue  # objects
                            raise
                        if held.dtype.kind not in "biuf":
                            if wanted is None:
                                continue
                            raise ValueError(f"{name} in {where} is not numeric")
                        if not held.size:
                            continue
                        table = held.reshape(1, -1) if held.ndim < 2 else held.reshape(len(held), -1)
                        for top in range(0, len(table), SLICE_ROWS):
                            part = table[top : top + SLICE_ROWS].astype(np.float64)
                            n, width = part.shape
                            ends = pa.array(np.arange(0, n * width + 1, width), pa.int32())
                            yield pa.record_batch(
                                [
                                    pa.array([where] * n, pa.string()),
                                    pa.array([name] * n, pa.string()),
                                    pa.array(np.arange(top, top + n), pa.int32()),
                                    pa.ListArray.from_arrays(ends, pa.array(part.ravel())),
                                ],
                                names=["path", "name", "row", "values"],
                            )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ROWS)


def write_arrays(rows: DataFrame, path: str, flat: Sequence[str] = (), max_bytes: int = ARCHIVE_BYTES) -> None:
    """One archive of (name, row, values): a matrix per name in row order, of ``flat`` names their only row as a vector."""
    size = rows.agg(F.sum(8 * F.size("values") + 32)).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"{size} bytes of arrays; an archive holds at most {max_bytes}")
    held: dict[str, list] = {}
    for r in sorted(rows.select("name", "row", "values").collect(), key=lambda r: (r["name"], r["row"])):
        held.setdefault(r["name"], []).append(r["values"])
    out = {name: np.array(values[0] if name in flat else values, dtype=np.float64) for name, values in held.items()}
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **out)
    context = rows.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place, True)
    stream.write(bytearray(buffer.getvalue()))
    stream.close()
