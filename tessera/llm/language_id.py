"""Language ID by rank-order profiles: out-of-place distance between a text's most frequent n-grams and each language's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, filled, slices

#: n-grams of a profile.
PROFILE = 300
#: What a text without a letter, or one that no language can be learned for, gets.
UNKNOWN = "und"
#: What a text with a letter gets from a strict judgement where nothing was learned (ISO 639: no code).
UNLEARNED = "mis"

#: Bytes of text counted at once: some 150 bytes of memory for each.
SLICE = 1 << 20

_FOLD: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a space; made once per process."""
    if not _FOLD:
        table = np.full(0x110000, 0x20, np.int64)
        for a in range(0, 0x110000, 0x1000):
            for c in range(a, a + 0x1000):
                if chr(c).isalpha():
                    table[c] = c
        _FOLD.append(table)
    return _FOLD[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """1- to 3-grams of the lower-cased words of the texts, each word between two spaces; the gram as a number
    (21 bits a letter) and the text it comes from. A gram that is a space, or has one inside, doesn't count."""
    padded = [f" {t.lower()} " for t in texts]
    codes = _letters()[np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, padded), np.int64, len(padded)))
    blank = codes == 0x20
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (doc[1:] == doc[:-1]))
    codes, doc, blank = codes[keep], doc[keep], blank[keep]
    one = ~blank
    grams, at = [codes[one]], [doc[one]]
    if len(codes) > 1:
        same = doc[1:] == doc[:-1]
        two = (codes[:-1] << 21) | codes[1:]
        grams.append(two[same])
        at.append(doc[1:][same])
        if len(codes) > 2:
            ok = same[1:] & same[:-1] & ~blank[1:-1]
            grams.append(((two[:-1] << 21) | codes[2:])[ok])
            at.append(doc[2:][ok])
    return np.concatenate(grams), np.concatenate(at)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent grams, ties by the gram's number; ``grams`` ascend."""
    return grams[np.argsort(-counts, kind="stable")[:most]]


def _per_text(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, distinct grams ascending, counts) of every text that has a letter."""
    grams, at = ngrams(texts)
    order = np.argsort(at, kind="stable")
    grams, at = grams[order], at[order]
    cuts = np.searchsorted(at, np.arange(len(texts) + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), *np.unique(grams[cuts[k] : cuts[k + 1]], return_counts=True)


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each non-null language over all given texts, most frequent first.

    Tasks count with numpy and emit one row per language and distinct gram of theirs; sums are shuffled by
    gram, so a language with most of the rows burdens no single task, and only ``size`` rows per language
    and task reach the ranking. The driver gets languages x size numbers.
    """

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        pending = 0

        def flush():
            for lang, parts in held.items():
                grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for part in slices(batches, most=SLICE):
            langs, texts = part.column("lang").to_pylist(), filled(part.column("text")).to_pylist()
            for lang in sorted(set(langs)):
                grams, n = np.unique(ngrams([t for t, x in zip(texts, langs) if x == lang])[0], return_counts=True)
                held.setdefault(lang, []).append((grams, n))
                pending += len(grams)
            if pending > 1_000_000:
                yield from flush()
                pending = 0
        yield from flush()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in sums.withColumn("k", rank).where(F.col("k") <= size).orderBy("lang", "k").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Profiles:
    """Profiles as arrays: all grams ascending, and each language's rank of each (its profile's size if absent)."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.rank = np.full((len(self.langs), len(self.grams) + 1), size, np.int64)
        self.rank[:, -1] = size
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def judge(self, grams: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        """The nearest language and how far it stands from the next."""
        return self.met(grams, counts)[:2]

    def met(self, grams: np.ndarray, counts: np.ndarray) -> tuple[str, float, bool]:
        """The nearest language, how far it stands from the next: (second - first) / largest distance, and whether it
        is nearer than the largest distance, that is, shares an n-gram."""
        top = ranked(grams, counts, self.size)
        at = np.searchsorted(self.grams, top)
        at = np.where(self.grams[np.minimum(at, len(self.grams) - 1)] == top, at, len(self.grams))
        rank = self.rank[:, at]
        away = np.where(rank == self.size, self.size, np.abs(rank - np.arange(len(top)))).sum(axis=1)
        order = np.argsort(away, kind="stable")
        most = self.size * len(top)
        second = away[order[1]] if len(order) > 1 else most
        return self.langs[order[0]], float(second - away[order[0]]) / most, bool(away[order[0]] < most)


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", strict: bool = False) -> DataFrame:
    """Adds lang_pred and score (0 to 1, 0 where the two nearest languages are equally near) to the columns of docs.

    Only the text is read, as a whole. Null texts and texts without a letter get ``und`` and 0; so do all
    where nothing was learned. With ``strict``, texts that share no n-gram with any profile get ``und`` and 0 too,
    but those with a letter ``mis`` and 0 where nothing was learned. Of equally near languages the first by name wins. Repeated rows are judged
    alike; an empty table gives none. Columns of docs named lang_pred or score are replaced, all others pass
    through unchanged.
    """
    known = Profiles(profiles) if profiles else None

    def judge(texts):
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known or strict:
            for k, grams, counts in _per_text(texts.to_pylist()):
                name, apart, met = known.met(grams, counts) if known else (UNLEARNED, 0.0, True)
                if met or not strict:
                    lang[k], score[k] = name, apart
        return [pa.array(lang, pa.string()), pa.array(score)]

    return beside(docs, text_col, [("lang_pred", "string"), ("score", "double")], judge, most=SLICE)
