"""Benchmark decontamination by spaced seeds: masks that ignore some positions, hash join, verified overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, hash_words, mixed, stored, word_array, word_ids

#: Positions that a seed compares (1) and ignores (0). Wherever up to 20 % of 10 to 20 words are substituted,
#: one of these masks still fits over equal words only; tests try every placement.
MASKS = ("10111", "11101", "110011")
#: Items of fewer words than WHOLE are sought as a whole, without substitutions; those of fewer than LEAST never match.
WHOLE, LEAST = 10, 5
#: An overlap is this many consecutive words of an item (the whole item if shorter) of which at least
#: SIMILAR percent stand at the same places of the document.
OVERLAP, SIMILAR = 20, 80
#: Words of the test set that a scan of the documents carries along; a larger test set takes more scans.
BLOCK_WORDS = 2_000_000
#: Seed hits whose surroundings are compared at once.
HITS = 1 << 14
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ –—‘’“”«»…¿¡"


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, lower-cased and without punctuation at their ends (words of nothing
    else are left out), and where each text's start."""
    words, first = word_array(texts)
    number, distinct = word_ids(words)
    plain = [w.lower().strip(_PUNCT) for w in distinct.to_pylist()]
    h = hash_words(pa.array(plain, pa.string()))
    keep = np.fromiter(map(bool, plain), bool, len(plain))[number] if len(number) else np.empty(0, bool)
    return h[number][keep], np.concatenate([[0], np.cumsum(keep)])[first]


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each place's words where the mask has 1."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, (len(mask) << 16) + int(mask, 2) % 65536, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[k : k + n]
    return mixed(out)


class TestSet:
    """A block of test items as sorted seed hashes with the places they come from."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words, self.first = normal_words(pa.array([t for _, t in items], pa.string()))
        n = np.diff(self.first)
        self.masks = sorted({*MASKS, *("1" * int(k) for k in n if LEAST <= k < WHOLE)})
        self.tables = []
        for mask in self.masks:
            seed = _seeds(self.words, mask)
            item = np.searchsorted(self.first, np.arange(len(seed)), "right") - 1
            inside = np.arange(len(seed)) + len(mask) <= self.first[item + 1]
            inside &= n[item] >= WHOLE if mask in MASKS else n[item] == len(mask)
            at = np.flatnonzero(inside)
            order = at[np.argsort(seed[at], kind="stable")]
            bits = np.zeros(1 << 22, bool)
            bits[(seed[order] >> np.uint64(42)).astype(np.int64)] = True
            self.tables.append((mask, seed[order], order, bits))

    def _near(self, h: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray, item: np.ndarray, width: int) -> np.ndarray:
        """Whether an overlap lies over each seed hit: at ``at`` of the text that has begin to end, at ``place`` of the item."""
        low, high = self.first[item], self.first[item + 1]
        span = np.minimum(OVERLAP, high - low)
        back = OVERLAP - width
        total = np.zeros((2 * OVERLAP - width + 1, len(at)), np.int64)
        for j in range(len(total) - 1):
            d, i = at + (j - back), place + (j - back)
            inside = (d >= begin) & (d < end) & (i >= low) & (i < high)
            total[j + 1] = total[j] + (inside & (h[np.where(inside, d, 0)] == self.words[np.where(inside, i, 0)]))
        best = np.zeros(len(at), np.int64)
        for j in range(back + 1):
            # an overlap from j on that ends after the seed and within the item
            stop, column = j + span, np.arange(len(at))
            fits = (place + (j - back) >= low) & (place + (stop - back) <= high) & (stop >= OVERLAP)
            best = np.maximum(best, np.where(fits, total[stop, column] - total[j], 0))
        return 100 * best >= np.where(high - low >= WHOLE, SIMILAR, 100) * span

    def overlaps(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(text, item's place in the block, share of equal words in the best overlap) of verified overlaps."""
        found: set[tuple[int, int, int]] = set()
        for mask, seeds, places, bits in self.tables:
            own = _seeds(h, mask)
            at = np.flatnonzero(bits[(own >> np.uint64(42)).astype(np.int64)])
            at = at[: len(own)]
            lo, hi = np.searchsorted(seeds, own[at], "left"), np.searchsorted(seeds, own[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            text = np.searchsorted(first, at, "right") - 1
            ok = at + len(mask) <= first[text + 1]
            at, text, lo, hi = at[ok], text[ok], lo[ok], hi[ok]
            ends = np.cumsum(hi - lo)
            for a in range(0, int(ends[-1]) if len(ends) else 0, HITS):
                hit = np.arange(a, min(a + HITS, int(ends[-1])))
                k = np.searchsorted(ends, hit, "right")
                place = places[hi[k] - ends[k] + hit]
                item = np.searchsorted(self.first, place, "right") - 1
                near = self._near(h, at[k], first[text[k]], first[text[k] + 1], place, item, len(mask))
                found.update(zip(text[k][near].tolist(), item[near].tolist(), (at[k] - place + self.first[item])[near].tolist()))
        for d, item, begin in sorted(found):
            words = self.words[self.first[item] : self.first[item + 1]]
            lo, hi = max(begin, int(first[d])), min(begin + len(words), int(first[d + 1]))
            equal = np.zeros(len(words), np.int64)
            equal[lo - begin : hi - begin] = h[lo:hi] == words[lo - begin : hi - begin]
            span = min(OVERLAP, len(words))
            total = np.concatenate([[0], np.cumsum(equal)])
            best = int((total[span:] - total[:-span]).max())
            if 100 * best >= (SIMILAR if len(words) >= WHOLE else 100) * span:
                yield d, item, best / span


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    held, words = [], 0
    for r in items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).orderBy(id_col, text_col).toLocalIterator():
        held.append((r[0], r[1]))
        words += len(r[1].split())
        if words >= BLOCK_WORDS:
            yield held
            held, words = [], 0
    if held:
        yield held


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds contaminated (boolean), item_id (of the item with the best overlap, the smallest of equal ones; null
    if none) and overlap (share of equal words in it; 0 if none) to the columns of docs.

    A text is contaminated if 20 consecutive words of a test item (or all, if it has fewer) stand in it at the
    same distances with at least 80 % of them equal; of items of fewer than 10 words, all must be. Candidates are places where one of three masks of 5
    or 6 words, which ignore 1 or 2 of them, has the hash of a place of an item: every overlap has such a place,
    wherever its substituted words stand. Each is verified along its diagonal. Words are compared lower-cased without punctuation
    at their ends.

    The test set goes to the tasks in blocks of some 2 million words (at most the words of one item more). A block
    is broadcast, passes over the documents, and is released before the next one is read; between blocks the
    documents are written to the shared folder with their best overlap so far. So no memory grows with the
    test set, and documents are never shuffled.

    Null and empty texts are clean. Items that are null, or of fewer than 5 words, match nothing. Repeated
    items count once. Columns of docs named contaminated, item_id or overlap are replaced; others pass through.
    """
    out, held = docs, None
    for block in _blocks(items, item_id, item_text):
        if held is not None:
            out = stored(out, "decontaminated")
            held.unpersist()
        out, held = _pass(out, block, text_col, first=held is None)
    return out if held is not None else _pass(docs, [], text_col, first=True)[0]


def _pass(docs: DataFrame, block: list[tuple[int, str]], text_col: str, first: bool) -> tuple[DataFrame, Broadcast]:
    """docs with the best overlap with the items of a block or, after the first, of all blocks so far."""
    shared = docs.sparkSession.sparkContext.broadcast(TestSet(block))

    def judge(texts):
        best: dict[int, tuple[float, int]] = {}
        h, starts = normal_words(texts)
        test = shared.value
        for d, item, share in test.overlaps(h, starts):
            best[d] = max(best.get(d, (0.0, 0)), (share, -int(test.ids[item])))
        hit = [best.get(k) for k in range(len(texts))]
        return [
            pa.array([x is not None for x in hit], pa.bool_()),
            pa.array([x and -x[1] for x in hit], pa.int64()),
            pa.array([x[0] if x else 0.0 for x in hit], pa.float64()),
        ]

    if first:
        return beside(docs, text_col, [("contaminated", "boolean"), ("item_id", "long"), ("overlap", "double")], judge), shared
    met = beside(docs, text_col, [("__dc_hit", "boolean"), ("__dc_item", "long"), ("__dc_share", "double")], judge)
    better = F.col("__dc_hit") & (~F.col("contaminated") | (F.col("__dc_share") > F.col("overlap")) | ((F.col("__dc_share") == F.col("overlap")) & (F.col("__dc_item") < F.col("item_id"))))
    met = met.withColumns(
        {
            "item_id": F.when(better, F.col("__dc_item")).otherwise(F.col("item_id")),
            "overlap": F.when(better, F.col("__dc_share")).otherwise(F.col("overlap")),
            "contaminated": F.col("contaminated") | F.col("__dc_hit"),
        }
    )
    return met.drop("__dc_hit", "__dc_item", "__dc_share"), shared


def brute_force(text: str | None, items: list[tuple[int, str]]) -> tuple[bool, int | None, float]:
    """The same for one text, by every alignment with every item."""
    plain = lambda t: [w for w in (x.decode().lower().strip(_PUNCT) for x in (t or "").encode().split()) if w]
    doc, best = plain(text), (0.0, 0)
    for item, t in items:
        words = plain(t)
        if len(words) < LEAST:
            continue
        span = min(OVERLAP, len(words))
        for begin in range(-len(words) + 1, len(doc)):
            equal = [0 <= begin + k < len(doc) and doc[begin + k] == w for k, w in enumerate(words)]
            top = max(sum(equal[k : k + span]) for k in range(len(words) - span + 1))
            if 100 * top >= (SIMILAR if len(words) >= WHOLE else 100) * span:
                best = max(best, (top / span, -item))
    return (True, -best[1], best[0]) if best[0] else (False, None, 0.0)
