"""Language identification by rank-order profiles of character n-grams (out-of-place distance).

A profile is the list of a text's most frequent n-grams, n = 1 to 3 within a word that is padded with one blank on each
side, by descending count, ties by code.  A language's profile comes from a bounded sample of labelled texts
(about ``SAMPLE`` different texts of each language, those with the least hashes).  A document's score for a language is the sum, over the
n-grams of its own profile, of how far apart their ranks are; an n-gram that the language's profile lacks counts as
its whole length.  The nearest language wins, ties by name.

The whole text is counted: letters in lower case, everything else is a blank.  Documents are independent of each other
and their texts are not shuffled but for the sample; the profiles, some kilobytes, go to all tasks.

A null text, or one without a letter, is `und` with score 0.  Without any labelled text all are `und`.  Rows with a null
language teach nothing; a null id is never held out.  Rows are independent: equal rows get equal results.  An empty
table gives an empty one.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import arrow_map, saved, small_batches, small_or_not

#: N-grams in a profile; different labelled texts of a language that it is learned from.
PROFILE, SAMPLE = 300, 1000
_BITS = 21  # of a code point
#: Code points that are counted together.
_CHUNK = 1 << 20


def _letters() -> np.ndarray:
    """The lower-case code point of each letter; a blank for everything else."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


_table: list[np.ndarray] = []


def fold(text: str) -> np.ndarray:
    """Code points, between blanks."""
    if not _table:
        _table.append(_letters())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes) + 2, 32, np.uint32)
    out[1:-1] = _table[0][codes]
    return out


def grams(text: str) -> np.ndarray:
    """The code of every n-gram: its code points after one another; a longer one has a higher mark."""
    codes = fold(text)
    letter = codes != 32
    wide = codes.astype(np.uint64)
    two = (wide[:-1] << np.uint64(_BITS)) | wide[1:]
    three = (two[:-1] << np.uint64(_BITS)) | wide[2:]
    pairs = letter[:-1] | letter[1:]
    # A blank in the middle belongs to two words.
    triples = letter[1:-1]
    return np.concatenate([wide[letter], two[pairs], three[triples] | np.uint64(1 << 63)])


def profile(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, the most frequent first."""
    codes, counts = np.unique(grams(text), return_counts=True)
    return top(codes, counts, size)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        own = counts >= least
        codes, counts = codes[own], counts[own]
    return codes[np.lexsort((codes, -counts))][:size]


@dataclass(frozen=True)
class Profiles:
    """The learned profiles: sorted n-grams, and for each the languages that have it with its rank there."""

    names: list[str]
    codes: np.ndarray
    #: Where each n-gram's languages and ranks start, and where the last one's end.
    first: np.ndarray
    langs: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, learned: dict[str, np.ndarray], size: int) -> Profiles:
        names = sorted(learned)
        lengths = [len(learned[x]) for x in names]
        every = np.concatenate([np.zeros(0, np.uint64), *(learned[x] for x in names)])
        order = np.argsort(every, kind="stable")
        codes, first = np.unique(every[order], return_index=True)
        langs = np.repeat(np.arange(len(names)), lengths)[order]
        ranks = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in lengths)])[order]
        return cls(names, codes, np.append(first, len(every)), langs, ranks, size)

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's profile to each language's."""
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = len(self.codes) - 1
        place = np.flatnonzero(self.codes[at] == own)
        at = at[place]
        many = self.first[at + 1] - self.first[at]
        # The rows of langs and ranks that the n-grams found have.
        row = np.arange(many.sum()) + np.repeat(self.first[at] - np.cumsum(many) + many, many)
        near = self.size - np.abs(self.ranks[row] - np.repeat(place, many))
        return self.size * len(own) - np.bincount(self.langs[row], near, len(self.names)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): by how much nearer it is than the next, from 0.5 for a tie to 1."""
        own = profile(text, self.size) if text else np.zeros(0, np.uint64)
        if not len(own) or not self.names:
            return "und", 0.0
        far = self.distances(own)
        order = np.argsort(far, kind="stable")
        if len(order) == 1:
            return self.names[order[0]], 1.0 - far[order[0]] / (self.size * len(own))
        best, second = float(far[order[0]]), float(far[order[1]])
        return self.names[order[0]], second / (best + second) if second else 0.5


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: dict[str, list[str]] = {}
        for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts.setdefault(name, []).append(text)
        for name, own in texts.items():
            held, n = [], 0
            for i, text in enumerate(own):
                held.append(grams(text))
                n += len(held[-1])
                if n >= _CHUNK or i == len(own) - 1:
                    codes, counts = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "code", "n"])
                    held, n = [], 0


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages of the labelled rows, each from about ``sample`` different texts (all, if there are fewer)."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    # The hash, evenly spread over 0 .. 2^63 - 1, below or at its language's limit puts a text in the sample; copies count once.
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    counts = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    rate = F.when(F.col("n") <= sample, F.lit((1 << 63) - 1)).otherwise((F.lit(float(sample)) / F.col("n") * float(1 << 63)).cast("long"))
    limits = saved(counts.select("lang", F.greatest(rate, "least").alias("limit")), "limits")
    chosen = rows.join(small_or_not(limits), "lang").where("h <= limit").select("lang", "text").distinct()
    sums = arrow_map(chosen, _count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = sums.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "code")), False), 1, 4 * size).alias("best")).collect()
    learned = {}
    for row in best:
        counted = np.array([(x["n"], x["code"]) for x in row["best"]], np.int64).reshape(-1, 2)
        learned[row["lang"]] = top(counted[:, 1].copy().view(np.uint64), counted[:, 0], size)
    return Profiles.of(learned, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(x.as_py()) for x in batch.column("text")]
            columns = [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return arrow_map(rows, predict, "doc_id long, lang_pred string, score double")


def fold_of(id_col: str, folds: int, held: int):
    """Whether a row is held out: crc32 of its id as text leaves ``held``; a null id is not."""
    remainder = F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(folds))
    return F.coalesce(remainder == held, F.lit(False))
