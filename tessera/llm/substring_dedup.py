"""Substring dedup by super-k-mers: consecutive windows with one minimiser travel as one packed string to its
bucket, where sorting counts windows exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, hash_words, mixed, ragged, rolling, slices, word_array, word_ids

#: Words in the runs among which a window's minimiser is chosen: long enough that no single word, nor a
#: frequent pair of words, draws a large share of all windows into one bucket.
SEED_WORDS = 3
_SMALLEST = -(2**63)


def repeated(word: np.ndarray, window: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether each window has an equal one before it. ``at`` has the windows' first words in the order in
    which the first counts, ``window`` their hashes, ``word`` the number of every word. Windows with one hash
    are compared word for word; the (never seen) ones that differ from the first are compared by their words."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    order = np.argsort(window, kind="stable")
    sorted_ = window[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.flatnonzero(~new)
    a, b = at[order[later]], at[first[later]]
    equal = np.ones(len(later), bool)
    for k in range(length):
        equal &= word[a + k] == word[b + k]
    out[order[later[equal]]] = True
    if not equal.all():
        seen: set[bytes] = set()
        clash = set(window[order[later[~equal]]].tolist())
        for i in np.flatnonzero(np.isin(window, np.fromiter(clash, np.uint64))):
            key = word[at[i] : at[i] + length].tobytes()
            out[i] = key in seen
            seen.add(key)
    return out


def _minimiser(h: np.ndarray, span: int) -> np.ndarray:
    """The smallest of h[i:i+span] for each i."""
    out, have = h, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _runs(start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of entries whose start follows the one before by 1 and that agree in all of ``same``: first entry, entries."""
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate([[True], start[1:] != start[:-1] + 1])
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.concatenate([first, [len(start)]]))


_OUT = "bucket int, kind int, doc_id long, text_key long, from_word long, to_word long, blob binary"
_FIELDS = [("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("from_word", pa.int64()), ("to_word", pa.int64()), ("blob", pa.binary())]


def _batch(n: int, **cols) -> pa.RecordBatch:
    arrays = [pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in _FIELDS]
    return pa.RecordBatch.from_arrays(arrays, names=[k for k, _ in _FIELDS])


#: Bytes of input to a bucket at most, where the number of shuffle partitions asks for fewer buckets.
BUCKET = 64 << 20
#: Bytes of text in a slice; repeats within it don't travel.
SLICE = 8 << 20


def _split(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each slice: what repeats within it (kind 0: words from_word to to_word of a document are covered), and
    the super-k-mers of windows that are first within it, packed by bucket (kind 1)."""
    for part in slices(batches, most=SLICE):
        # the slice in the order in which "earlier" is meant
        part = part.take(pc.sort_indices(part, sort_keys=[("doc_id", "ascending"), ("text_key", "ascending")]))
        docs, keys = part.column("doc_id").to_numpy(), part.column("text_key").to_numpy()
        words, first = word_array(filled(part.column("text")))
        if len(words) < length:
            continue
        number, distinct = word_ids(words)
        h = hash_words(distinct)[number]
        window = rolling(h, length)
        n_words = np.diff(first)
        doc = np.repeat(np.arange(len(docs)), n_words)
        start = np.flatnonzero(doc[: len(window)] == doc[length - 1 :])
        if not len(start):
            continue
        seed = _minimiser(rolling(h, min(SEED_WORDS, length)), length - min(SEED_WORDS, length) + 1)
        # a repeated row (same id and text) is one document given twice: neither stands earlier
        twin = np.concatenate([[False], (docs[1:] == docs[:-1]) & (keys[1:] == keys[:-1])])
        start = start[~twin[doc[start]]]
        again = repeated(number, window[start], start, length)
        gone, held = start[again], start[~again]
        a, n = _runs(gone, doc[gone])
        if len(a):
            d = doc[gone[a]]
            frm = gone[a] - first[d]
            # any bucket will do; spread by document
            yield _batch(len(a), bucket=(mixed(docs[d].view(np.uint64)) % np.uint64(buckets)).astype(np.int32), kind=np.zeros(len(a), np.int32), doc_id=docs[d], text_key=keys[d], from_word=frm, to_word=frm + n + length - 1)
        a, n = _runs(held, doc[held], seed[held])
        bucket = (mixed(seed[held[a]]) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        a, n, bucket = a[order], n[order], bucket[order]
        s = held[a]
        spaced = pc.binary_join_element_wise(words, "", " ")
        offset = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset :]
        data = memoryview(spaced.buffers()[2])
        lo, hi = offset[s].tolist(), offset[s + n + length - 1].tolist()
        pieces = [data[x:y] for x, y in zip(lo, hi)]
        d = doc[s]
        meta = [docs[d], keys[d], s - first[d], n]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        pack = pa.Codec("zstd", compression_level=6)
        blobs = []
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            raw = np.array([y - x], "<i8").tobytes() + np.concatenate([m[x:y] for m in meta]).astype("<i8").tobytes() + b"".join(pieces[x:y])
            blobs.append(len(raw).to_bytes(8, "little") + pack.compress(raw, asbytes=True))
        yield _batch(len(blobs), bucket=bucket[cuts[:-1]], kind=np.ones(len(blobs), np.int32), blob=blobs)


def _count(table: pa.Table, length: int) -> pa.Table:
    """Of a bucket: the words covered by windows that start earlier elsewhere, and what came as kind 0."""
    kind = table.column("kind").to_numpy()
    out = [table.filter(pa.array(kind == 0)).select(["doc_id", "text_key", "from_word", "to_word"])]
    codec = pa.Codec("zstd")
    metas, texts = [], []
    for blob in table.filter(pa.array(kind == 1)).column("blob").to_pylist():
        raw = codec.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), asbytes=True)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        metas.append(np.frombuffer(raw, "<i8", 4 * n, 8).reshape(4, n))
        texts.append(raw[8 + 32 * n :])
    if metas:
        doc, key, frm, n = np.concatenate(metas, axis=1)
        text = b"".join(texts)
        words, _ = word_array(pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(text)], np.int64)), pa.py_buffer(text)))
        number, distinct = word_ids(words)
        size = n + length - 1
        begin = np.cumsum(size) - size
        order = np.lexsort((frm, key, doc))
        window = rolling(mixed(np.arange(1, len(distinct) + 1, dtype=np.uint64))[number], length)
        at = ragged(begin[order], n[order])
        owner = np.repeat(order, n[order])
        d, k, f, e = doc[order], key[order], frm[order], (frm + n)[order]
        if ((d[1:] == d[:-1]) & (k[1:] == k[:-1]) & (f[1:] < e[:-1])).any():
            # a repeated row brought a window twice: it counts once
            place = frm[owner] + at - begin[owner]
            order = np.lexsort((place, key[owner], doc[owner]))
            at, owner, place = at[order], owner[order], place[order]
            new = np.concatenate([[True], (np.diff(place) != 0) | (np.diff(doc[owner]) != 0) | (np.diff(key[owner]) != 0)])
            at, owner = at[new], owner[new]
        again = repeated(number, window[at], at, length)
        at, owner = at[again], owner[again]
        a, m = _runs(at, owner)
        k = owner[a]
        f = frm[k] + at[a] - begin[k]
        out.append(pa.table({"doc_id": pa.array(doc[k]), "text_key": pa.array(key[k]), "from_word": pa.array(f), "to_word": pa.array(f + m + length - 1)}))
    return pa.concat_tables(x.cast(out[0].schema) for x in out)


def repeated_spans(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Spans of words (doc_id, text_key, from_word, to_word) covered by windows that also start earlier.

    A first pass drops windows that repeat within a slice of 8 MB of text, so a passage that a third of
    all documents hold leaves each slice once; the rest goes to buckets by the hash of the window's minimiser.
    A bucket holds about 1 / buckets of the distinct text, packed with zstd; by default there are 16 for each
    shuffle partition, or more if the planner's size of the input asks for it: a bucket of BUCKET bytes each, so
    that a bucket, which one task unpacks, doesn't grow with the corpus.
    """
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = buckets or min(2**30, max(16 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET))
    rows = _keyed(docs, id_col, text_col).where(F.col("text").isNotNull())
    packed = rows.mapInArrow(lambda b: _split(b, length, buckets), _OUT)
    return packed.groupBy("bucket").applyInArrow(lambda t: _count(t, length), "doc_id long, text_key long, from_word long, to_word long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_SMALLEST)).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words, first = word_array(filled(part.column("text")))
        delta = np.zeros(len(words) + 1, np.int64)
        spans = part.column("spans")
        owner = pc.list_parent_indices(spans).to_numpy()
        flat = spans.flatten()
        if len(flat):
            np.add.at(delta, first[owner] + flat.field("from_word").to_numpy(), 1)
            np.add.at(delta, first[owner] + flat.field("to_word").to_numpy(), -1)
        keep = np.cumsum(delta[:-1]) == 0
        kept = words.filter(pa.array(keep))
        ends = np.concatenate([[0], np.cumsum(keep)])[first]
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), kept), " ")
        n, left = np.diff(first), np.diff(ends)
        names = part.column("doc_id").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(names, mask=names == _SMALLEST), pa.array(n), pa.array(n - left), text], names=["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Removes each word covered by a window of ``length`` words whose word sequence also starts earlier
    (smaller id, or earlier in the document). Returns id, n_words, n_removed and kept_text (words joined by one space).

    Words are runs of bytes other than space and tab to carriage return, compared as they are. Windows are
    judged on the input. Null, empty and blank texts have no words and kept_text ''. Rows with one id but
    different texts are ordered by the texts' hashes; a row repeated with the same id and text is one document
    given twice, gets the same result each time and doesn't repeat itself. A null id is smaller than any other.
    Texts shorter than a window stay. Other columns are ignored.

    Shuffled: packed windows (about 2.9 times the words, compressed), spans, and the text once to meet its spans.
    """
    spans = repeated_spans(docs, length, id_col, text_col, buckets)
    spans = spans.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.collect_list(F.struct("from_word", "to_word")).alias("spans"))
    base = _keyed(docs, id_col, text_col)
    met = base.join(spans.hint("shuffle_hash"), (F.col("doc_id") == F.col("_d")) & (F.col("text_key") == F.col("_k")), "left")
    met = met.select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<from_word:bigint,to_word:bigint>>")).alias("spans"))
    out = met.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("doc_id", id_col)


def brute_force(rows: list[tuple[int, str | None]], length: int = 20) -> list[tuple[int, int, int, str]]:
    """The same on a small list, by a dictionary of all windows: (id, words, removed, sha256 of the kept text)."""
    seen: set[tuple] = set()
    out = []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
