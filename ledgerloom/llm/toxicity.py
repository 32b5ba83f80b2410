"""Toxicity by a weighted lexicon, matched by one Aho-Corasick automaton.

Texts are folded one character to one: lower case, look-alike letters of other scripts to Latin ones, digits and, between
letters, `@` and `$` to the letters that they stand for, everything that is no letter to a blank.  A lexicon entry is a
word beginning; it matches where a word of the folded text begins with it, and the longest entry of a word counts.
Matches inside an exception phrase don't count.

A document's evidence is the sum of its matches' weights; it enters a logistic score as such and normalised by length
(for each 100 words), both on a logarithmic scale.

``fit`` learns entries, weights and the score's coefficients from a bounded sample of labelled rows (``SAMPLE``, by a
hash of the id).  An entry's weight is the log-ratio of the shares of toxic and other documents that have it; entries
need a significant association, and of nested ones the most significant stays, the longest of equals.  ``SEEDS`` are in
the lexicon from the start, so a score exists without labels.  Fitting brings to the driver, for the sample, the
entries that each document has; scoring reads whole texts, shuffles nothing and is independent for each row.

Null and empty texts score like texts without matches.  Rows without a label, or with a null one, teach nothing.  If an
id has several labels, each counts; if it has several texts, each counts.  Equal rows get equal scores.  An empty table
gives an empty one.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import arrow_map, kept, small_batches

THRESHOLD = 0.3
#: Labelled rows to learn from, about.
SAMPLE = 12_000
#: Lengths of word beginnings that are candidates, and the longest word taken whole.
SHORTEST, LONGEST = 3, 12
#: Least log-ratio and least G-statistic of an entry; share of the toxic documents below which it must add new ones.
RATIO, STATISTIC, COMMON, NEW = 1.8, 24.0, 0.02, 0.3

# The seed lexicon and the phrases in which its words are harmless.
SEEDS = (
    "arschloch bastard bitch clown connard cretin disgusting dumbass estupido fuck hurensohn idiot idiota imbecile loser miststueck moron "
    "pathetic pendejo retard salaud scum scheisse stupid trash verpiss wichser worthless"
).split()
EXCEPTIONS = ("class clown", "clown fish", "idiot proof", "idiots guide", "stupid question", "trash bag", "trash bin", "trash can", "trash collection", "white trash bag")
# Letters that look like Latin ones, and the Latin ones; digits and signs, and the letters that they replace.
LOOK_ALIKE = ("абвгеёікмнортсухѕјԁԛԝһαβεικνορτυχ", "abbreeikmhoptcyxsjdqwhabeikvoptux")
DIGITS = ("0134578", "oieastb")
SIGNS = {"@": "a", "$": "s"}

SEED_WEIGHT = 3.0
_START = (-4.0, 1.5, 0.5)


def _fold_table() -> np.ndarray:
    """What each code point becomes; signs stay, their neighbours decide."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            plain = unicodedata.normalize("NFKC", c)
            low = (plain if len(plain) == 1 else c).lower()
            table[i] = ord(low) if len(low) == 1 else i
        elif c.isdigit():
            table[i] = ord(str(unicodedata.digit(c)))
    for source, target in (LOOK_ALIKE, DIGITS):
        to = dict(zip(map(ord, source), map(ord, target), strict=True))
        low = np.isin(table, list(to))
        table[low] = [to[x] for x in table[low].tolist()]
    for sign in SIGNS:
        table[ord(sign)] = ord(sign)
    return table


_table: list[np.ndarray] = []


def fold(text: str) -> str:
    """The folded text, as long as the original, after one blank and before one."""
    if not _table:
        _table.append(_fold_table())
    codes = np.full(len(text) + 2, 32, np.uint32)
    codes[1:-1] = _table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    for sign, letter in SIGNS.items():
        at = np.flatnonzero(codes == ord(sign))
        if len(at):
            inside = ((codes[at - 1] > 64) & (codes[at + 1] > 64)) if len(codes) > 2 else np.zeros(len(at), bool)
            codes[at] = np.where(inside, ord(letter), 32)
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEEDS, SEED_WEIGHT))
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = _START

    def score(self, evidence: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-_features(evidence, n_words) @ np.array(self.coefficients)))


def _features(evidence: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    rate = 100.0 * evidence / np.maximum(n_words, 1)
    return np.stack([np.ones(len(evidence)), np.log1p(evidence), np.log1p(rate)], axis=1)


class Matcher:
    """The automaton of a lexicon, built once in each Python worker."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.automaton.add_word(f" {entry}", (len(entry) + 1, weight, entry))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None, phrase))
        self.automaton.make_automaton()

    @classmethod
    def of(cls, lexicon: dict[str, float], exceptions: tuple[str, ...]) -> Matcher:
        return kept(("lexicon", tuple(sorted(lexicon.items())), exceptions), lambda: cls(lexicon, exceptions))

    def matches(self, folded: str) -> list[tuple[int, str, float]]:
        """(place of the word, entry, weight): the longest entry of each word outside the exception phrases."""
        found: dict[int, tuple[int, str, float]] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight, entry) in self.automaton.iter(folded) if len(self.automaton) else ():
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            elif start not in found or found[start][0] < size:
                found[start] = (size, entry, weight)
        if not excused:
            return [(s, e, w) for s, (_, e, w) in found.items()]
        # Both in order of their places: a match is excused by the phrase that began before it and reaches furthest.
        excused.sort()
        out, at, reach = [], 0, -1
        for s, (n, e, w) in sorted(found.items()):
            while at < len(excused) and excused[at][0] <= s:
                reach = max(reach, excused[at][1])
                at += 1
            if s + n - 1 > reach:
                out.append((s, e, w))
        return out


def _words(folded: str) -> int:
    return len(folded.split())


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other texts have a word with each beginning; those that toxic ones have."""
    toxic: dict[str, int] = {}
    clean: dict[str, int] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts = toxic if label else clean
            for x in {w[:n] for w in set(fold(text or "").split()) for n in range(SHORTEST, min(len(w), LONGEST) + 1)}:
                counts[x] = counts.get(x, 0) + 1
    own = list(toxic)
    yield pa.RecordBatch.from_arrays(
        [pa.array(own, pa.string()), pa.array([toxic[x] for x in own], pa.int64()), pa.array([clean.get(x, 0) for x in own], pa.int64())], names=["entry", "toxic", "clean"]
    )
    rest = [x for x in clean if x not in toxic]
    yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([clean[x] for x in rest], pa.int64())], names=["entry", "toxic", "clean"])


def _found(lexicon: dict[str, float], exceptions: tuple[str, ...]):
    """The entries of each text, with their number, and its length in words."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.of(lexicon, exceptions)
        for batch in batches:
            entries, sizes = [], []
            for text in batch.column("text").to_pylist():
                folded = fold(text or "")
                entries.append([e for _, e, _ in matcher.matches(folded)])
                sizes.append(_words(folded))
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.list_(pa.string())), pa.array(sizes, pa.int64()), batch.column("toxic")], names=["entries", "n_words", "toxic"])

    return found


def _statistic(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """G of the two shares' difference."""
    total, both = toxic + clean, t + c

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    cells = ((t, toxic, both), (c, clean, both), (toxic - t, toxic, total - both), (clean - c, clean, total - both))
    return 2.0 * reduce(add, (part(seen, side * row / total) for seen, side, row in cells))


def _ratio(t: Column, c: Column, toxic: int, clean: int) -> Column:
    return F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (clean + 1.0))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a small ridge; the two slopes are not allowed below 0."""
    free, beta = [0, 1, 2], np.zeros(3)
    while True:
        z, ridge = x[:, free], np.diag([1e-3] + [1e-1] * (len(free) - 1))
        beta = np.zeros(len(free))
        for _ in range(60):
            p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        worst = int(np.argmin(beta[1:])) + 1 if len(free) > 1 else 0
        if not worst or beta[worst] >= 0:
            out = np.zeros(3)
            out[free] = beta
            return tuple(out.tolist())
        del free[worst]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model learned from about ``sample`` of the labelled documents."""
    small_batches(docs.sparkSession)
    marks = labels.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("doc is not null and toxic is not null")
    n = marks.count()
    marks = marks.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < min(1 << 20, (sample << 20) // max(n, 1)))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(marks) if n else marks, "doc")
    # Copies of a text would lend their words weight; one of each counts.
    rows = rows.where("text is not null").select("text", "toxic").dropDuplicates().persist()
    try:
        sides = {r["toxic"]: r["count"] for r in rows.select((F.col("toxic") != 0).cast("int").alias("toxic")).groupBy("toxic").count().collect()}
        toxic, clean = sides.get(1, 0), sides.get(0, 0)
        if not toxic or not clean:
            return Model()
        counted = arrow_map(rows.select("text", (F.col("toxic") != 0).cast("int").alias("toxic")), _candidates, "entry string, toxic long, clean long")
        counted = counted.groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        t, c = F.col("t"), F.col("c")
        ranked = counted.where(t >= 3).select("entry", "t", F.round(_statistic(t, c, toxic, clean), 6).alias("g"), _ratio(t, c, toxic, clean).alias("ratio")).where((F.col("g") >= STATISTIC) & (F.col("ratio") >= RATIO))
        learned: dict[str, tuple[float, int]] = {}
        begun: set[str] = set()
        for r in sorted(ranked.collect(), key=lambda r: (-r["g"], -len(r["entry"]), r["entry"])):
            beginnings = [r["entry"][:n] for n in range(1, len(r["entry"]) + 1)]
            if r["entry"] not in begun and not any(x in learned for x in beginnings):
                learned[r["entry"]] = (r["ratio"], r["t"])
                begun.update(beginnings)
        lexicon = dict.fromkeys(SEEDS, SEED_WEIGHT) | {e: w for e, (w, _) in learned.items()}
        found = arrow_map(rows, _found(lexicon, EXCEPTIONS), "entries array<string>, n_words long, toxic int").collect()
    finally:
        rows.unpersist()
    chosen = _useful(learned, [set(r["entries"]) for r in found if r["toxic"]], toxic)
    seeds = {x: SEED_WEIGHT for x in SEEDS if not any(x.startswith(y) for y in chosen)}
    final = seeds | chosen
    evidence = np.array([sum(final.get(e, 0.0) for e in r["entries"]) for r in found])
    y = np.array([float(r["toxic"] != 0) for r in found])
    return Model(final, EXCEPTIONS, _logistic(_features(evidence, np.array([r["n_words"] for r in found])), y))


def _useful(learned: dict[str, tuple[float, int]], having: list[set[str]], toxic: int) -> dict[str, float]:
    """Common entries, and rare ones if they show enough documents that no common one does."""
    common = {e for e, (_, t) in learned.items() if t >= COMMON * toxic}
    new = Counter(e for x in having if not x & common for e in x)
    return {entry: weight for entry, (weight, t) in learned.items() if entry in common or new[entry] >= NEW * t}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, matches) of every row; matches: the entries found, with their places in characters."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.of(model.lexicon, model.exceptions)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("entry", pa.string())]))
        for batch in batches:
            evidence, sizes, matches = [], [], []
            for text in batch.column("text"):
                folded = fold(text.as_py() or "")
                own = matcher.matches(folded)
                evidence.append(sum(w for _, _, w in own))
                sizes.append(_words(folded))
                matches.append([{"start": s, "entry": e} for s, e, _ in own])
            value = model.score(np.array(evidence, float), np.array(sizes, float))
            columns = [batch.column("doc_id"), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(matches, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "matches"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return arrow_map(rows, scored, "doc_id long, score double, predicted int, matches array<struct<start:int,entry:string>>")


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.of(model.lexicon, model.exceptions)
        for batch in batches:
            evidence, sizes = [], []
            for text in batch.column(text_col):
                folded = fold(text.as_py() or "")
                evidence.append(sum(w for _, _, w in matcher.matches(folded)))
                sizes.append(_words(folded))
            yield batch.filter(pa.array(model.score(np.array(evidence, float), np.array(sizes, float)) < threshold))

    small_batches(docs.sparkSession)
    return arrow_map(docs, below, docs.schema)
