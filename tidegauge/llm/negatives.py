"""Hard negatives: for each anchor and positive, the most similar rows of other labels just below the positive.

Anchors meet all rows in cells of one block of anchors and one chunk of rows. A cell keeps, for each anchor, what can be
among the first ones of the whole table: its own first positives, and later its own first negatives at or below each
of the anchor's positives. What is kept is packed into keys (anchor, falling score, id) and sorted by a shuffle that
partitions on the anchor alone; a stream over the sorted keys opens a window at each positive and emits negatives as they
come, with a few numbers of one anchor in memory.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidegauge.llm.texts import bound_batches, written
from tidegauge.llm.vectors import ID, LABEL, X, matrix, whole_vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The contract's fixed values.
FACTOR, ANCHORS, RELABEL, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
# Scaled components stay below this, so that a product of two vectors of up to 64 components is a long.
LIMIT = 1 << 28
# Anchors of a block, rows of a chunk at most and about, and anchors scored at a time: bounds of a task's memory.
BLOCK, CHUNK, SLAB = 1024, 16_384, 64
_LEAST_CHUNK = 1024

# A key sorts by anchor, falling score, id (null last) and row; the last byte marks a positive.
_KEY = np.dtype([("anchor", ">u8"), ("place", ">u8"), ("score", ">u8"), ("null", "u1"), ("id", ">u8"), ("row", ">u8"),
                 ("positive", "u1")])
_ANCHOR_BYTES = 16
_FOUND = pa.schema([("key", pa.binary())])
_SIGN = 1 << 63


def keys(anchor, place, score, ids, nulls, row, positive) -> np.ndarray:
    """Packed keys, one for each entry; signed numbers are shifted so that bytes sort as the numbers do."""
    made = np.zeros(len(score), _KEY)
    for name, values in (("anchor", anchor), ("id", ids)):
        made[name] = np.asarray(values, np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    made["score"] = ~(np.asarray(score, np.int64).view(np.uint64) ^ np.uint64(_SIGN))
    made["place"], made["row"], made["null"], made["positive"] = place, row, nulls, positive
    return made


def _table(made: list[np.ndarray]) -> pa.Table:
    """One column of keys; bytes are joined, as joined arrays would change their order."""
    raw = b"".join(part.tobytes() for part in made)
    packed = pa.Array.from_buffers(pa.binary(_KEY.itemsize), len(raw) // _KEY.itemsize, [None, pa.py_buffer(raw)])
    return pa.table([packed.cast(pa.binary())], schema=_FOUND)


def first_columns(score: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's first `count` allowed entries by falling score, then by column."""
    width = score.shape[1]
    if int(np.abs(score).max(initial=0)) < (1 << 62) // (width + 1):
        # Score and column in one number: no two are equal.
        order = score * width + np.arange(width - 1, -1, -1)
        order[~allowed] = np.iinfo(np.int64).min
    else:
        order = np.where(allowed, np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1) * -1, np.iinfo(np.int64).min)
    if width > count:
        part = np.argpartition(order, width - count, axis=1)[:, width - count:]
    else:
        part = np.broadcast_to(np.arange(width), score.shape)
    rows, at = np.nonzero(np.take_along_axis(allowed, part, axis=1))
    return rows, part[rows, at]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of both: in doubles while those hold every whole number that can come up."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Chunk:
    """A cell's rows, by rising id, nulls last, then by row number."""

    def __init__(self, table: pa.Table):
        nulls = table["vec_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        ids = table["vec_id"].fill_null(0).to_numpy()
        row = table["row"].to_numpy()
        order = np.lexsort((row, ids, nulls))
        self.nulls, self.ids, self.row = nulls[order], ids[order], row[order]
        self.label = table[LABEL].to_numpy()[order]
        self.x = matrix(table[X].combine_chunks())[order]

    def keys(self, anchor, place, score, at, positive) -> np.ndarray:
        return keys(anchor, place, score, self.ids[at], self.nulls[at], self.row[at], positive)


def _cell_positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Keys of each anchor's first rows of its own label, the anchor's own row left out."""
    made = []
    if anchors.num_rows and rows.num_rows:
        chunk, a = Chunk(rows), matrix(anchors[X].combine_chunks())
        label, ids, place = (anchors[c].to_numpy() for c in (LABEL, ID, "row"))
        for at in range(0, len(a), SLAB):
            own = slice(at, at + SLAB)
            score = products(a[own], chunk.x)
            allowed = (label[own, None] == chunk.label) & (place[own, None] != chunk.row)
            who, which = first_columns(score, allowed, POSITIVES)
            made.append(chunk.keys(ids[own][who], place[own][who], score[who, which], which, 1))
    return _table(made)


def _cell_negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Keys of each anchor's first rows of other labels within the window of any of its positives."""
    made = []
    if anchors.num_rows and rows.num_rows:
        chunk, a = Chunk(rows), matrix(anchors[X].combine_chunks())
        label, ids, place = (anchors[c].to_numpy() for c in (LABEL, ID, "row"))
        tops = np.full((len(a), POSITIVES), -1, np.int64)
        for tops_row, scores in zip(tops, anchors["scores"].to_pylist()):
            tops_row[:len(scores)] = scores
        for at in range(0, len(a), SLAB):
            own = slice(at, at + SLAB)
            score = products(a[own], chunk.x)
            other = label[own, None] != chunk.label
            taken = []
            for top in tops[own].T:
                # A window below zero holds nothing: its lower end lies above its upper one.
                floor = np.where(top >= 0, -(-(LEAST * top) // 100), np.iinfo(np.int64).max)[:, None]
                who, which = first_columns(score, other & (score <= top[:, None]) & (score >= floor), NEGATIVES)
                taken.append(who * score.shape[1] + which)
            # Windows overlap; what several of them take is sent once.
            cells = np.unique(np.concatenate(taken))
            who, which = cells // score.shape[1], cells % score.shape[1]
            made.append(chunk.keys(ids[own][who], place[own][who], score[who, which], which, 0))
    return _table(made)


def _unpacked(packed: Iterator[bytes]) -> Iterator[tuple[bytes, int, int, int | None, bool, bytes]]:
    """anchor's bytes, anchor's id, score, id, whether it is a positive, and the key itself."""
    for key in packed:
        key = bytes(key)
        yield (key[:_ANCHOR_BYTES], int.from_bytes(key[:8], "big") - _SIGN, _SIGN - 1 - int.from_bytes(key[16:24], "big"),
               None if key[24] else int.from_bytes(key[25:33], "big") - _SIGN, bool(key[41]), key)


def first_positives(packed: Iterator[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Row of the anchor, score and key of each anchor's first positives, from sorted keys."""
    anchor, count = None, 0
    for own, _, score, _, _, key in _unpacked(packed):
        if own != anchor:
            anchor, count = own, 0
        if count < POSITIVES:
            count += 1
            yield int.from_bytes(own[8:], "big"), score, key


def mined(packed: Iterator[bytes]) -> Iterator[tuple]:
    """Rows of the result from sorted keys of positives and negatives.

    A positive opens a window. A negative joins each open window that it lies in. Negatives of a positive's
    own score may come before it, as ties go by id, so the first few of the present score are remembered.
    """
    anchor, windows, level, tied = None, [], None, []
    for own, anchor_id, score, other, positive, _ in _unpacked(packed):
        if own != anchor:
            anchor, windows, level, tied = own, [], None, []
        if score != level:
            level, tied = score, []
            # Windows that are full, or too far above, take nothing more.
            windows = [w for w in windows if w[2] < NEGATIVES and 100 * score >= LEAST * w[1]]
        if positive:
            window = [other, score, 0]
            windows.append(window)
            joined = [(window, n) for n in tied] if 100 * score >= LEAST * score else []
        else:
            joined = [(w, other) for w in windows]
            if len(tied) < NEGATIVES:
                tied.append(other)
        for window, negative in joined:
            if window[2] < NEGATIVES and 100 * score >= LEAST * window[1]:
                window[2] += 1
                yield anchor_id, window[0], window[2], negative, window[1], score


def _sorted(found, partitions: int):
    """Keys dealt out by anchor and sorted in each partition."""
    return found.map(lambda key: (bytes(key), None)).repartitionAndSortWithinPartitions(
        partitions, lambda key: zlib.crc32(key[:_ANCHOR_BYTES])).keys()


def _in_cells(anchors: DataFrame, rows: DataFrame, blocks: int, chunks: int, work) -> DataFrame:
    """Each block of anchors with each chunk of rows, both of bounded size."""
    def number(n: int):
        return F.pmod(F.xxhash64("row"), F.lit(n))

    def all_of(n: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = anchors.withColumn("block", number(blocks)).withColumn("chunk", all_of(chunks))
    right = rows.withColumn("chunk", number(chunks)).withColumn("block", all_of(blocks))
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(work, from_arrow_schema(_FOUND))


def hard_negatives(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see the module's text.

    Rows with a null label or without a usable vector take no part (see `whole_vectors`). A null id is no anchor; as a positive
    or negative it comes after all ids of its score, and so may be returned. Rows are told apart by their place in the
    table: repeated ids are rows of their own, and each of several anchors of one id gets its own result rows. Without
    anchors, positives or negatives there are no rows.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    changed = F.when(F.col(ID) % RELABEL == 0, F.pmod(F.col(LABEL) + 1, F.lit(LABELS))).otherwise(F.col(LABEL))
    whole = (whole_vectors(rows, FACTOR, 0, LIMIT, key, vector, label).filter(F.col(LABEL).isNotNull())
             .withColumn(LABEL, changed).withColumn("row", F.monotonically_increasing_id()))
    stored = written(whole.select("row", ID, LABEL, X), "vectors")
    # Columns of their own, as both sides of the cells come from one table.
    anchors = stored.filter(F.col(ID) % ANCHORS == 0).select(*[F.col(c).alias(c) for c in stored.columns])
    total, first = stored.count(), anchors.count()
    at_once = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-first // BLOCK))
    chunks = max(1, -(-total // CHUNK), min(-(-total // _LEAST_CHUNK), 2 * at_once))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    near = _in_cells(anchors, stored, blocks, chunks, _cell_positives)
    tops = _sorted(near.rdd.map(lambda r: r[0]), partitions).mapPartitions(first_positives)
    positives = written(spark.createDataFrame(tops, "row BIGINT, score BIGINT, key BINARY"), "positives")
    scores = positives.groupBy("row").agg(F.sort_array(F.collect_list("score")).alias("scores"))
    below = _in_cells(anchors.join(scores, "row"), stored, blocks, chunks, _cell_negatives)
    both = _sorted(below.unionByName(positives.select("key")).rdd.map(lambda r: r[0]), partitions)
    return spark.createDataFrame(both.mapPartitions(mined), (
        "anchor_id BIGINT, positive_id BIGINT, rank INT, negative_id BIGINT, positive_score BIGINT, negative_score BIGINT"))
