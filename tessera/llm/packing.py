"""Best-two-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored
from .encode import SLICE, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-two-fit over a histogram of lengths: (lengths with their multiplicity, descending; number of such bins).

    A bin opens with the longest document left and is filled greedily, the longest that fits first. Then its
    smallest document goes back if two unpacked ones fit the gap that this leaves and fill more of it; the
    two with the largest sum are taken. A bin of one document stays as it is. A composition is repeated for
    as long as all its lengths last, so the work depends on the number of different lengths (at most
    ``capacity``), not on the number of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    bins = []
    while left.any():
        used: dict[int, int] = defaultdict(int)
        gap = capacity
        while True:
            fits = np.flatnonzero(left[: gap + 1])
            fits = fits[fits > 0]
            if not len(fits):
                break
            length = int(fits[-1])
            n = min(int(left[length]), gap // length)
            used[length] += n
            left[length] -= n
            gap -= n * length
        if gap and sum(used.values()) > 1:
            small = min(used)
            room = gap + small
            there = np.flatnonzero(left[: room + 1])
            if len(there):
                below = np.maximum.accumulate(np.where(left[: room + 1] > 0, np.arange(room + 1), 0))
                partner = below[np.minimum(there, room - there)]
                # a length that would be its own partner must be there twice
                alone = (partner == there) & (left[there] < 2)
                partner = np.where(alone, below[np.maximum(np.minimum(there, room - there) - 1, 0)], partner)
                total = np.where(partner > 0, there + partner, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    used[small] -= 1
                    left[small] += 1
                    for length in (int(there[best]), int(partner[best])):
                        used[length] += 1
                        left[length] -= 1
        made = sorted(((k, n) for k, n in used.items() if n), reverse=True)
        copies = 1 + min(int(left[k]) // n for k, n in made)
        for k, n in made:
            left[k] -= n * (copies - 1)
        bins.append((made, copies))
    return bins


def pieces_of(docs: DataFrame, tokenizer_path: str, pieces: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its place in its document, its length, crc32 of its ids, and its number among the
    pieces of that length in its task (``pid``, ``nth``)."""

    def cut(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        enc, before = encoder(tokenizer_path, pieces), np.zeros(capacity + 1, np.int64)
        for part in slices(batches, most=SLICE):
            ids, at = enc.encode(part.column("text"))
            ids = ids.astype("<u4")
            names = part.column("doc_id").to_pylist()
            rows: list[tuple] = []
            end = np.array([end_id], "<u4")
            for name, a, b in zip(names, at[:-1].tolist(), at[1:].tolist()):
                own = np.concatenate([ids[a:b], end])
                for k, s in enumerate(range(0, len(own), capacity)):
                    one = own[s : s + capacity]
                    n = len(one)
                    rows.append((name, k, s, n, zlib.crc32(one.tobytes()), pid, before[n]))
                    before[n] += 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "pid", "nth"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, pieces: str = "words", end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents (ids and one end id each) into sequences of at most ``capacity`` tokens.

    Only documents longer than a sequence are cut. Returns a row per piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset (gapless from 0 in each sequence).

    Pieces are written once to the shared folder (without ids, about 40 bytes each). The plan needs only the
    number of pieces of each length, at most ``capacity`` numbers, so it is exact over the whole corpus and
    made on the driver; a piece finds its bin by its number among the pieces of its length. These numbers
    come from per-task counts: (length, task) pairs are summed in order of the task, so no task ever holds
    all pieces of a length.

    Null or empty text: the end id alone. Repeated ids: each row is packed as a document of its own. Empty
    table: no rows. Other columns are ignored.
    """
    cut = stored(pieces_of(docs, tokenizer_path, pieces, end_id, capacity, id_col, text_col), "pieces")
    per_task = cut.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")
    base = per_task.select(F.col("length").alias("_length"), F.col("pid").alias("_pid"), before.alias("_base"))
    counts = {r[0]: r[1] for r in cut.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most `capacity` rows
    plan: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # length: first number, of each bin, first bin, offset
    taken: dict[int, int] = defaultdict(int)
    first = 0
    for made, copies in plan_bins(counts, capacity):
        offset = 0
        for length, n in made:
            plan[length].append((taken[length], n, first, offset))
            taken[length] += n * copies
            offset += n * length
        first += copies
    table = {k: np.array(v, np.int64) for k, v in plan.items()}

    def place(batches):
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                t = table[int(k)]
                row = t[np.searchsorted(t[:, 0], number[at], "right") - 1]
                within = number[at] - row[:, 0]
                seq[at] = row[:, 2] + within // row[:, 1]
                off[at] = row[:, 3] + within % row[:, 1] * k
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = cut.join(base, (F.col("length") == F.col("_length")) & (F.col("pid") == F.col("_pid")))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
