"""Token files in patched frame-of-reference blocks.

Layout (little-endian)::

    "TPF1"
    blocks: base u32, width u8, exceptions u8, BLOCK ids packed at ``width`` bits (id - base, low bits first),
            positions u8 of the exceptions, their id - base as u32
    block starts u64 (one for each block), document ids i64, tokens of each document u32
    blocks u64, documents u64, tokens u64, start of the block starts u64, "TPF1"

The width of a block is that of its 90th-percentile difference; what needs more is an exception. The last
block is filled up with its last id.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, slices, stored
from .encode import SLICE, encoder

MAGIC = b"TPF1"
BLOCK = 256
PERCENTILE = 90
_HEAD = 6


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of ids (a multiple of BLOCK of them) and where each starts."""
    rows = ids.astype(np.uint32).reshape(-1, BLOCK)
    base = rows.min(axis=1)
    diff = rows - base[:, None]
    k = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.ceil(np.log2(np.partition(diff, k, axis=1)[:, k].astype(np.float64) + 1)).astype(np.int64)
    odd = diff >> np.minimum(width, 31).astype(np.uint32)[:, None] != 0
    odd &= (width < 32)[:, None]
    n_odd = odd.sum(axis=1)
    size = _HEAD + width * (BLOCK // 8) + 5 * n_odd
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.empty((len(rows), _HEAD), np.uint8)
    head[:, :4] = base.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5] = width, n_odd
    out[starts[:, None] + np.arange(_HEAD)] = head
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        bits = np.unpackbits(diff[at].astype("<u4").view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        out[(starts[at] + _HEAD)[:, None] + np.arange(w * BLOCK // 8)] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
    block, position = np.nonzero(odd)
    if len(block):
        nth = np.arange(len(block)) - (np.cumsum(n_odd) - n_odd)[block]
        tail = (starts + _HEAD + width * (BLOCK // 8))[block]
        out[tail + nth] = position
        value = diff[block, position].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(tail + n_odd[block] + 4 * nth)[:, None] + np.arange(4)] = value
    return out.tobytes(), starts


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks of ``data`` that begin at ``starts``."""
    head = data[starts[:, None] + np.arange(_HEAD)]
    base = np.ascontiguousarray(head[:, :4]).view("<u4").reshape(-1).astype(np.uint32)
    width, n_odd = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    diff = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        packed = data[(starts[at] + _HEAD)[:, None] + np.arange(w * BLOCK // 8)]
        bits = np.zeros((len(at), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(at), BLOCK, w)
        diff[at] = np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(at), BLOCK)
    block = np.repeat(np.arange(len(starts)), n_odd)
    if len(block):
        nth = np.arange(len(block)) - (np.cumsum(n_odd) - n_odd)[block]
        tail = (starts + _HEAD + width * (BLOCK // 8))[block]
        value = np.ascontiguousarray(data[(tail + n_odd[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        diff[block, data[tail + nth]] = value
    return (diff + base[:, None]).reshape(-1)


#: Stands for a null document id in a file, whose ids are 64-bit numbers.
_NULL = -(2**63)


def _filesystem(folder: str):
    """The file system of a folder and its path there; s3a and s3n are Hadoop's names for what pyarrow calls s3."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


class Writer:
    """Writes one token file; memory is bounded by what one ``add`` brings."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        self.rest = np.empty(0, np.uint32)
        self.starts: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.tokens = 0
        out.write(MAGIC)

    def _blocks(self, ids: np.ndarray, step: int = BLOCK * 2048) -> None:
        for i in range(0, len(ids), step):
            data, starts = encode_blocks(ids[i : i + step])
            self.out.write(data)
            self.starts.append(starts + self.at)
            self.at += len(data)

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.ids.append(doc_ids.astype("<i8"))
        self.sizes.append(sizes.astype("<u4"))
        self.tokens += len(ids)
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._blocks(np.concatenate([self.rest, np.full(BLOCK - len(self.rest), self.rest[-1], np.uint32)]))
        starts = np.concatenate([np.empty(0, np.int64), *self.starts]).astype("<u8")
        ids, sizes = np.concatenate([np.empty(0, "<i8"), *self.ids]), np.concatenate([np.empty(0, "<u4"), *self.sizes])
        for x in (starts, ids, sizes, np.array([len(starts), len(ids), self.tokens, self.at], "<u8")):
            self.out.write(x.tobytes())
        self.out.write(MAGIC)


def read_file(source, step: int = 8192):
    """Of an open token file: document ids, their tokens, and a generator of runs of ids of at most step blocks."""
    size = source.size()
    source.seek(size - 36)
    foot = source.read(36)
    if foot[32:] != MAGIC:
        raise ValueError("not a token file, or cut off")
    n_blocks, n_docs, n_tokens, at = np.frombuffer(foot[:32], "<u8").astype(np.int64).tolist()
    source.seek(at)
    starts = np.frombuffer(source.read(8 * n_blocks), "<u8").astype(np.int64)
    ids = np.frombuffer(source.read(8 * n_docs), "<i8")
    sizes = np.frombuffer(source.read(4 * n_docs), "<u4").astype(np.int64)

    def runs():
        left = n_tokens
        for i in range(0, n_blocks, step):
            own = starts[i : i + step]
            end = starts[i + step] if i + step < n_blocks else at
            source.seek(int(own[0]))
            got = decode_blocks(np.frombuffer(source.read(int(end - own[0])), np.uint8), own - own[0])[:left]
            left -= len(got)
            yield got

    return ids, sizes, runs()


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, pieces: str = "spaced", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Encodes documents in ascending id order, one file for each range of ids; returns the manifest:
    shard (in order of ids), file, n_docs, n_tokens, start (ids in all files before).

    ``folder`` must be reachable by all executors. Each attempt of a task writes a file of its own name; only
    files of attempts that succeeded are in the manifest, others are deleted. Rows with equal ids stand in
    one file, ordered by the hash of their text. Null text: the end id alone. Null ids: written first, as the
    smallest long, and null again when read. Empty table: an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession

    def write(batches):
        from pyspark import TaskContext

        fs, root = _filesystem(folder)
        enc, out, shard = encoder(tokenizer_path, pieces), None, TaskContext.get().partitionId()
        for part in slices(batches, most=SLICE):
            if out is None:
                name = f"{root}/part-{shard:06d}-{uuid.uuid4().hex}.tpf"
                stream = fs.open_output_stream(name)
                out = Writer(stream)
            ids, at = enc.encode(part.column("text"))
            n = len(at) - 1
            all_ids = np.full(len(ids) + n, end_id, np.uint32)
            all_ids[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
            out.add(part.column("doc_id").to_numpy(), np.diff(at) + 1, all_ids)
        if out is not None:
            out.close()
            stream.close()
            row = [shard, name.rpartition("/")[2], sum(map(len, out.ids)), out.tokens]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["shard", "file", "n_docs", "n_tokens"])

    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    made = stored(rows.mapInArrow(write, "shard long, file string, n_docs long, n_tokens long"), "token-manifest").orderBy("shard").collect()  # a row for each file
    known, start, manifest = {r.file for r in made}, 0, []
    from pyarrow.fs import FileSelector

    for x in fs.get_file_info(FileSelector(root)):
        if x.base_name.endswith(".tpf") and x.base_name not in known:
            fs.delete_file(x.path)
    for r in made:
        manifest.append((r.shard, r.file, r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(manifest, "shard long, file string, n_docs long, n_tokens long, start long")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches):
        fs, root = _filesystem(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as source:
                    ids, sizes, runs = read_file(source)
                    ends = np.cumsum(sizes)
                    crc = np.zeros(len(ids), np.int64)
                    doc, done = 0, 0
                    for run in runs:
                        data, stop = memoryview(run.astype("<u4").tobytes()), done + len(run)
                        at = done
                        while doc < len(ids) and at < stop:
                            to = min(int(ends[doc]), stop)
                            crc[doc] = zlib.crc32(data[4 * (at - done) : 4 * (to - done)], int(crc[doc]))
                            at = to
                            doc += int(at == ends[doc])
                        done = stop
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == _NULL), pa.array(first + ends - sizes), pa.array(sizes), pa.array(crc)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, manifest.count())
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark) -> str:
    """A new folder for token files, in the shared folder of the session."""
    return f"{shared_folder(spark)}/tessera-tokens-{uuid.uuid4().hex}"
