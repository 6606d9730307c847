"""P7 on text files: entries are assembled in the splits they are read in.

A task of the text source reads its splits line by line, in order.  So most
entries begin and end where they are read, and only two pieces of a split may
belong to an entry of several splits: the lines before its first header and
its last entry.  ``split_pieces`` puts whole entries together from Arrow
batches (lists are cut out of the batch's own line array, no line is touched
by itself) and marks these two as edges; ``stitched`` brings the edges of one
entry together.  Lines are never shuffled or sorted, edges apart.

The fold holds one batch and the entry that is still open.  A file that
cannot be split (such as a gzip file) is one long split and streams through
the same way.  An entry that outgrows an Arrow list (2 GB) is an error that
names its file and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Codes of the kinds of lines.
HEADER, STACK, MORE, BLANK = 0, 1, 2, 3
LARGEST_ENTRY = (1 << 31) - (1 << 20)

PIECES = ("file_path string, _block long, _at long, _whole boolean, _lines long, _hk int, raw string, more array<string>, "
          "stack array<string>")


def _lists(value: pa.Array, rows: np.ndarray, unit: np.ndarray, units: int) -> pa.Array:
    """One list per unit: the values of ``rows`` that fall into it."""
    ends = np.cumsum(np.bincount(unit[rows], minlength=units))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), value.take(pa.array(rows)))


def split_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file_path, _block, _id, _hk, _kind, value) in order, a split's lines together -> PIECES.

    A piece begins at a header or at a split's first line.  ``_at`` is its place in the split, ``_whole`` says that it
    is an entry that ends inside the split, and the piece that ends a split has the split's number of lines."""
    held: list[pa.RecordBatch] = []   # the lines of the piece that is still open
    last, first_id, held_bytes = None, 0, 0

    def pieces(lines: list[pa.RecordBatch], closing: bool) -> pa.RecordBatch:
        nonlocal first_id
        table = pa.concat_batches(lines)
        kind, opens = table.column("_kind").to_numpy(), table.column("_opens").to_numpy(zero_copy_only=False)
        ids, value = table.column("_id").to_numpy(), table.column("value")
        begins = opens | (kind == HEADER)
        first = np.flatnonzero(begins)
        units = len(first)
        unit = np.cumsum(begins) - 1
        ends = np.append(first[1:], len(kind)) - 1
        closes = np.append(opens[first[1:]], closing)
        whose = np.maximum.accumulate(np.where(opens[first], np.arange(units), -1))
        base = np.where(whose >= 0, ids[first][whose], first_id)
        first_id = int(base[-1])
        header = kind[first] == HEADER
        at = pa.array(first)
        return pa.record_batch([
            table.column("file_path").take(at), table.column("_block").take(at), pa.array(ids[first] - base),
            pa.array(header & ~closes), pa.array(ids[ends] - base + 1, mask=~closes), table.column("_hk").take(at),
            value.take(pa.array(first, mask=~header)),
            _lists(value, np.flatnonzero(kind == MORE), unit, units), _lists(value, np.flatnonzero(kind == STACK), unit, units),
        ], ["file_path", "_block", "_at", "_whole", "_lines", "_hk", "raw", "more", "stack"])

    for batch in batches:
        if not batch.num_rows:
            continue
        path, block = batch.column("file_path"), batch.column("_block").to_numpy()
        code = path.dictionary_encode().indices.to_numpy()
        opens = np.ones(batch.num_rows, bool)
        opens[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
        opens[0] = last != (path[0].as_py(), block[0])
        last = path[-1].as_py(), block[-1]
        batch = batch.append_column("_opens", pa.array(opens))
        begins = np.flatnonzero(opens | (batch.column("_kind").to_numpy() == HEADER))
        if len(begins):
            cut = int(begins[-1])
            done = [*held, batch.slice(0, cut)] if cut else held
            if done:
                yield pieces(done, bool(opens[cut]))
            batch, held, held_bytes = batch.slice(cut), [], 0
        held.append(batch)
        held_bytes += batch.column("value").nbytes
        if held_bytes > LARGEST_ENTRY:
            raise ValueError(f"an entry of over 2 GB in {last[0]}, split at byte {last[1]}, "
                             f"from line {held[0].column('_id')[0].as_py() - first_id + 1} of the split on")
    if held:
        yield pieces(held, True)


def split_table(edges: DataFrame) -> DataFrame:
    """One row per split: the lines before it in its file (``_before``) and the split of the last header before it
    (``_owner``, null if there is none)."""
    earlier = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return edges.where("_lines IS NOT NULL").select(
        "file_path", "_block", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"),
        F.max(F.when(F.col("raw").isNotNull(), F.col("_block"))).over(earlier).alias("_owner"))


def stitched(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """(file_path, line_number, raw, hd, more, stack) of the entries at the end of a split, with the lines that the next
    splits begin with; lines before a file's first header are dropped."""
    placed = edges.join(splits, ["file_path", "_block"]).select(
        "file_path", F.when(F.col("raw").isNotNull(), F.col("_block")).otherwise(F.col("_owner")).alias("_of"),
        F.when(F.col("raw").isNotNull(), F.struct((F.col("_before") + F.col("_at") + 1).alias("line_number"), "raw", "hd")).alias("h"),
        F.struct("_block", "more", "stack").alias("piece")).where("_of IS NOT NULL")
    whole = placed.groupBy("file_path", "_of").agg(F.max("h").alias("h"), F.array_sort(F.collect_list("piece")).alias("body"))
    return whole.select("file_path", "h.line_number", "h.raw", "h.hd", F.flatten("body.more").alias("more"),
                        F.flatten("body.stack").alias("stack"))
