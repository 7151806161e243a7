"""A table in parts that tasks read one at a time, for joins of every row with every part; nothing is broadcast."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.plans.scratch import new_path


def store(df: DataFrame, id: str, rows: int, make: Callable[[pa.Table], Any]) -> tuple[str, int]:
    """(folder, parts): what ``make`` makes of each part of ``df``, cut by a hash of the ``id`` into parts of about ``rows`` rows.

    Every part is made once, by a task of its own, and written to the shared folder. ``df`` is counted first, so it should be a table.
    """
    folder = new_path(df.sparkSession, "parts")
    parts = max(1, -(-df.count() // rows))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        where, inside = fs.FileSystem.from_uri(folder)
        where.create_dir(inside, recursive=True)
        whole = f"{inside}/{key[0].as_py()}.{uuid.uuid4().hex}"
        with where.open_output_stream(f"{whole}.part") as out:
            pickle.dump(make(table.drop_columns(["_part"])), out, protocol=5)
        where.move(f"{whole}.part", f"{whole}.whole")  # a task that dies leaves no file that looks complete
        return pa.table({"_part": pa.array([key[0].as_py()], pa.int32())})

    cut = df.withColumn("_part", F.pmod(F.xxhash64(id), F.lit(parts)).cast("int"))
    cut.groupBy("_part").applyInArrow(run, "_part int").write.format("noop").mode("overwrite").save()
    return folder, parts


_HELD: dict[tuple[str, int], Any] = {}


def load(folder: str, part: int) -> Any:
    """A stored part, None where no row fell into it; of several complete files (a task may have run twice) any is right.

    A worker keeps one, and lets it go before it reads another.
    """
    if (folder, part) not in _HELD:
        _HELD.clear()
        _HELD[folder, part] = _read(folder, part)
    return _HELD[folder, part]


def _read(folder: str, part: int) -> Any:
    where, inside = fs.FileSystem.from_uri(folder)
    if where.get_file_info(inside).type == fs.FileType.NotFound:
        return None
    found = sorted(f.path for f in where.get_file_info(fs.FileSelector(inside)) if f.base_name.startswith(f"{part}.") and f.base_name.endswith(".whole"))
    if not found:
        return None
    with where.open_input_stream(found[0]) as source:
        return pickle.load(source)
