"""Files cut at a separator, each split read on its own, with what a split must know of those before it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = ["file", "start"]


def cut(spark: SparkSession, path: str | Sequence[str], separator: str) -> DataFrame:
    """What lies between separators as ``value``, with its split (``file``, ``start``) and ``size`` of the file.

    ``row`` grows along a split and is unique, so pieces of a file are in order by ``start, row``.
    """
    read = spark.read.option("lineSep", separator).text(path if isinstance(path, str) else list(path))
    return read.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )


def along_splits(pieces: DataFrame, changes: Sequence[str] = ()) -> DataFrame:
    """Add what can be said of each piece within its split, without knowing how the split begins.

    ``flips`` of ``pieces`` counts the quotes of a piece. ``inside`` tells whether the piece begins in
    a quoted text if its split does not. ``changes`` names two columns: by how much a piece changes
    a depth if it begins outside, or inside, of a quoted text. ``depth0`` and ``depth1`` add these up
    over the earlier pieces of the split, if the split begins outside, or inside. ``even`` and
    ``odd`` are the last rows up to each that begin outside, or inside, if the split does not. Rows
    are taken as the scan gives them, one after the other, so this needs no shuffle.
    """
    added = [("inside", T.BooleanType()), ("even", T.LongType()), ("odd", T.LongType())]
    added += [("depth0", T.LongType()), ("depth1", T.LongType())] if changes else []
    schema = T.StructType([*pieces.schema, *(T.StructField(name, kind) for name, kind in added)])
    return pieces.mapInArrow(_walk(tuple(changes)), schema)


def _walk(changes):
    def walk(batches):
        import pyarrow as pa

        split, carried = None, None
        for batch in batches:
            for part in _by_split(batch):
                here = (part["file"][0].as_py(), part["start"][0].as_py())
                if here != split:
                    split, carried = here, {"inside": 0, "even": -1, "odd": -1, "depth0": 0, "depth1": 0}
                columns = _stretch(part, changes, carried)
                arrays = [pa.array(column, mask=column == -1 if name in ("even", "odd") else None) for name, column in columns]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *(name for name, _ in columns)])

    return walk


def _by_split(batch):
    """Parts of a batch that come from one split each."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    files, starts = batch["file"], batch["start"]
    same = pc.and_(pc.equal(files[1:], files[:-1]), pc.equal(starts[1:], starts[:-1])).to_numpy(zero_copy_only=False)
    ends = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
    for a, b in zip(ends, ends[1:]):
        yield batch.slice(a, b - a)


def _stretch(part, changes, carried):
    """The added columns of consecutive pieces of one split; ``carried`` goes on to the next ones."""
    rows, flips = part["row"].to_numpy(), part["flips"].to_numpy() & 1
    after = (np.cumsum(flips) + carried["inside"]) & 1
    inside = (after - flips) & 1
    carried["inside"] = int(after[-1])
    columns = [("inside", inside.astype(bool))]
    for name, begins in (("even", inside == 0), ("odd", inside == 1)):
        last = np.maximum(np.maximum.accumulate(np.where(begins, rows, -1)), carried[name])
        carried[name] = int(last[-1])
        columns.append((name, last))
    if changes:
        outer, inner = (part[name].to_numpy().astype(np.int64) for name in changes)
        for name, begun in (("depth0", inside), ("depth1", 1 - inside)):
            change = np.where(begun == 1, inner, outer)
            after = np.cumsum(change) + carried[name]
            carried[name] = int(after[-1])
            columns.append((name, after - change))
    return columns
