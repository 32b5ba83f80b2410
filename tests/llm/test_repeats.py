"""Deduplication operators against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ngram_join, suffix_dedup, window_index
from ledgerloom.llm.components import components
from ledgerloom.llm.lyndon import suffix_order

# Columns whose names clash with those that the operators make.
SCHEMA = "doc_id long, text string, doc string, stamp string, spans string, part int, kind int, h string, c string, n int, group string"
EXTRA = ("x", "x", "x", 1, 1, "x", "x", 1, "x")
EMPTY = "doc_id long, text string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA).repartition(3)


def corpus(seed, words=60, docs=40, size=40):
    """Few words, copies, near copies, shared passages, ties, nulls, empty and blank texts, one long one."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(25))
    rows = []
    for i in range(docs):
        own = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, size))]
        if rnd.random() < 0.4:
            own.insert(rnd.randrange(len(own) + 1), passage)
        rows.append((i, " ".join(own)))
        for k in range(rnd.randrange(0, 3)):
            copy = " ".join(own).split()
            for _ in range(k):
                if copy:
                    copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((100 + 10 * i + k, rnd.choice([" ", "\n"]).join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "É" * 300), (1004, "É" * 300), (1005, " ".join(rnd.choice(vocabulary) for _ in range(3000))), (1006, "a" * 5000)]
    rows += [rows[0], (5, "another text for id five " * 5), (1007, "W1 w1\x0bw2"), (1008, "w1 W1 W2")]
    rnd.shuffle(rows)
    return rows


def repeats(rows, length):
    seen = collections.Counter(b[k : k + length] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def windows(rows, length):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - length + 1) if i is not None else ():
            x = tuple(w[k : k + length])
            least[x] = min(least.get(x, i), i)
    out = []
    for i, w in split:
        gone = bytearray(len(w))
        for k in range(len(w) - length + 1) if i is not None else ():
            if least[tuple(w[k : k + length])] < i:
                gone[k : k + length] = b"\1" * length
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def groups(rows, size, percent=75):
    sets = []
    for _, t in rows:
        w = bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()).split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_suffix_order():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        texts = [np.append(rnd.integers(1, 1 + rnd.integers(1, 4), rnd.integers(0, 30)), 0) for _ in range(rnd.integers(1, 6))]
        starts = np.cumsum([0] + [len(t) for t in texts])[:-1]
        naive = [s + i for t, s in zip(texts, starts, strict=True) for i in sorted(range(len(t)), key=lambda i: t[i:].tolist())]
        assert suffix_order(np.concatenate(texts), starts).tolist() == naive


@pytest.mark.parametrize("seed, length, key", [(1, 40, 12), (2, 25, 25), (3, 60, 1)])
def test_suffix_dedup(spark, seed, length, key):
    rows = corpus(seed) + [(None, "null id " * 20), (None, "null id " * 20)]
    assert found(suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, rows), length=length, key=key))) == repeats(rows, length)


def test_null_ids_with_hashes_that_end_alike(spark):
    passage = " ".join(f"passage{i}" for i in range(60))
    end = F.xxhash64("text").bitwiseAND(0x7FFFFFFF)
    texts = spark.range(300_000).select(F.when(F.col("id") % 2 == 0, F.concat("id", F.lit(" " + passage))).otherwise(F.concat("id", F.lit(" alone"))).alias("text"))
    pairs = texts.groupBy(end.alias("end")).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").collect()
    pair = next(x.texts for x in pairs if len({len(t) > 100 for t in x.texts}) == 2)
    rows = [(None, t) for t in pair] + [(7, "other " + passage)]
    assert found(suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, rows), length=200))) == repeats(rows, 200)


def test_suffix_dedup_splits_large_sets(spark, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(suffix_dedup, "LARGE", 150)
    sets = suffix_dedup._Sets(np.frombuffer(b"xabcdefy" + b"zabcdefw" + b"qabcdefw", np.uint8), np.array([0, 8, 16, 24]), 4)
    sets.add(np.arange(3), np.zeros(3, int), np.full(3, 4), np.full(3, 2), np.full(3, 5))
    one = {(int(c), s) for batch in sets.batches() for c, s in zip(*sets.repeated(batch), strict=True)} | {(int(c), s) for c, f, e in sets.sure for c, f, e in zip(c, f, e, strict=True) for s in range(f, e + 1)}
    assert one >= {(c, s) for c in range(3) for s in (1, 2, 3)} and (0, 0) not in one and (0, 4) not in one
    assert found(suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, rows), length=40, key=8))) == repeats(rows, 40)


def test_suffix_dedup_default_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(suffix_dedup.digest(suffix_dedup.remove_repeats(docs))) == repeats(rows, 200)
    assert suffix_dedup.digest(suffix_dedup.remove_repeats(spark.createDataFrame([], EMPTY))).collect() == []


@pytest.mark.parametrize("seed, length, key, batches", [(5, 12, 4, 3), (6, 8, 8, 1), (7, 20, 1, 5)])
def test_window_index(spark, seed, length, key, batches):
    rows = corpus(seed) + [(None, "n " * 60), (2000, "n " * 60)]
    out = window_index.deduplicate(table(spark, rows), length=length, key=key, batches=batches)
    assert found(window_index.digest(out)) == windows(rows, length)


@pytest.mark.parametrize("fanout, tables", [(4, [1, 1, 1]), (0, [1, 2, 3])])
def test_window_index_grows(spark, monkeypatch, fanout, tables):
    monkeypatch.setattr(window_index, "FANOUT", fanout)
    rows = sorted({i: t for i, t in corpus(8)}.items())
    index = window_index.FingerprintIndex(4)
    got, history = [], None
    for part, kept in zip((rows[:30], rows[30:60], rows[60:]), tables, strict=True):
        docs = table(spark, part)
        got += window_index.digest(window_index.deduplicate(docs, length=10, key=4, index=index, history=history)).collect()
        history = docs if history is None else history.unionByName(docs)
        assert len(index.tables) == len(index.sizes) == kept
        place = window_index.table_path(spark, "manifest")
        index.save(spark, place)
        index = window_index.FingerprintIndex.load(spark, place)
    assert sorted(map(tuple, got), key=repr) == windows(rows, 10)
    index.compact(spark)
    assert len(index.tables) == 1 and index.count == 4
    again = window_index.deduplicate(table(spark, [(9000 + i, t) for i, t in rows]), length=10, key=4, index=index, history=history)
    assert {r.doc_id: r.n_removed for r in window_index.digest(again).collect()} == {9000 + i: r for i, r in covered(rows, 10).items()}
    assert window_index.deduplicate(spark.createDataFrame([], EMPTY)).collect() == []


def covered(rows, length):
    """Words of each text when all its windows were seen before."""
    return {i: n if n >= length else 0 for i, t in rows for n in [len((t or "").encode().split())]}


def test_merge_join_of_sorted_runs():
    rnd = np.random.default_rng(5)
    for _ in range(300):
        index, all_ = window_index._Runs([]), {}
        for b in range(4):
            batch = np.zeros(rnd.integers(0, 30), window_index._ENTRY)
            for name, most in (("key", 4), ("context", 4), ("doc", 12), ("first", 3)):
                batch[name] = rnd.integers(0, most, len(batch))
            rows = [tuple(int(x[n]) for n in ("key", "context", "doc")) for x in batch]
            least = dict(all_)
            for k, c, d in rows:
                least[k, c] = min(least.get((k, c), d), d)
            smallest = {}
            for (k, _), d in least.items():
                smallest[k] = min(smallest.get(k, d), d)
            removed, doubt, other, new = index.join(batch)
            plain = lambda x: sorted(tuple(int(y[n]) for n in ("key", "context", "doc")) for y in x)
            assert plain(removed) == sorted(x for x in rows if x[2] > least[x[:2]])
            doubtful = [x for x in rows if x[2] == least[x[:2]] and x[2] > smallest[x[0]]]
            assert plain(doubt) == sorted(doubtful)
            largest = {}
            for k, _, d in doubtful:
                largest[k] = max(largest.get(k, d), d)
            assert {(k, c, d) for (k, c), d in least.items() if d < largest.get(k, -1)} <= set(plain(other))
            assert all(d < largest[k] for k, _, d in plain(other))
            assert plain(new) == sorted((k, c, d) for (k, c), d in least.items() if all_.get((k, c), d + 1) > d)
            all_ = least
            index.add(new)
            merged = window_index._all_merged(index.runs)
            assert plain(merged) == [tuple(map(int, (x["key"], x["context"], x["doc"]))) for x in merged] == sorted((k, c, d) for (k, c), d in all_.items())


def test_jaccard_groups(spark):
    rows = corpus(9)
    got = found(ngram_join.near_duplicate_groups(table(spark, rows + [(None, "a b c d e f g")]), size=3).drop("n_links"))
    assert got == sorted([*groups(rows, 3), (None, 5, None)], key=repr)


LEVELS = {"whole": lambda df, n, p: ngram_join.WHOLE, "mixed": lambda df, n, p: (1, 2, 4, 16, ngram_join.WHOLE)[(n + len(df)) % 5]}


@pytest.mark.parametrize("levels", sorted(LEVELS))
def test_jaccard_levels_do_not_matter(spark, levels):
    rnd = random.Random(10)
    words = [f"v{k}" for k in range(50)]
    base = [rnd.choice(words) for _ in range(60)]
    rows = [(i, t) for i, t in corpus(11, docs=15)]
    for i in range(60):
        copy = list(base)
        for _ in range(rnd.randrange(0, 6)):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        rows.append((5000 + i, " ".join(copy)))
    got = found(ngram_join.near_duplicate_groups(table(spark, rows), size=2, choose=LEVELS[levels]).drop("n_links"))
    assert got == sorted(groups(rows, 2), key=repr)


def near_copies(size):
    """Copies of one text, each with its own edits, a third of them so many that they link with few others."""
    rnd = random.Random(size)
    base = [f"word{k}" for k in range(150)]
    rows = []
    for i in range(size):
        copy = list(base)
        for _ in range(rnd.choice((1, 2, 4))):
            copy[rnd.randrange(len(copy))] = f"edit{rnd.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("lone", [0])
def test_comparisons_grow_with_the_group_not_its_square(spark, monkeypatch, lone):
    monkeypatch.setattr(ngram_join, "LONE", lone)
    monkeypatch.setattr(ngram_join, "FEW", 50)
    compared, verified = [], ngram_join._Join.verified

    def counted(self, pairs, sets):
        compared.append(pairs.count())
        return verified(self, pairs, sets)

    monkeypatch.setattr(ngram_join._Join, "verified", counted)
    for size in (200, 400, 800):
        rows = near_copies(size)
        compared.clear()
        got = found(ngram_join.near_duplicate_groups(table(spark, rows)).drop("n_links"))
        assert sum(compared) < 24 * size
        if size < 800:
            assert got == sorted(groups(rows, 5), key=repr)
        else:
            assert {c for _, _, c in got} == {0}


def test_candidates_of_a_group_that_only_its_center_links(spark, monkeypatch):
    """Texts that link with the unedited one only are found by it, not as candidates of all of the group."""
    rnd = random.Random(4)
    base, rows = [f"word{k}" for k in range(150)], [(0, " ".join(f"word{k}" for k in range(150)))]
    for i in range(1, 400):
        copy = list(base)
        for at in rnd.sample(range(5, 145, 6), 4 if i % 2 else 1 + i % 3):
            copy[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(copy)))
    made, candidates = [], ngram_join._Join.candidates

    def counted(self, *given):
        out = candidates(self, *given)
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join._Join, "candidates", counted)
    assert found(ngram_join.near_duplicate_groups(table(spark, rows)).drop("n_links")) == sorted(groups(rows, 5), key=repr)
    assert made[0] < len(rows)


def test_groups_that_do_not_link_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONE", 0)
    monkeypatch.setattr(ngram_join, "FEW", 10)
    rnd = random.Random(3)
    shared, rows = [f"s{k}" for k in range(100)], []
    for g in range(6):
        own = shared + [f"g{g}w{k}" for k in range(30)]
        for i in range(25):
            copy = list(own)
            for _ in range(i % 4):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(10**9)}"
            rows.append((100 * g + i, " ".join(copy)))
    assert found(ngram_join.near_duplicate_groups(table(spark, rows)).drop("n_links")) == sorted(groups(rows, 5), key=repr)


def test_very_long_texts(spark):
    words = [f"w{k % 9973}x{k}" for k in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:100_000])), (3, " ".join(words[:80_000])), (4, "w " * 150_000), (5, "w " * 20)]
    assert found(ngram_join.near_duplicate_groups(table(spark, rows)).drop("n_links")) == sorted(groups(rows, 5), key=repr)
    assert found(window_index.digest(window_index.deduplicate(table(spark, rows[:3])))) == windows(rows[:3], 50)


def test_level_grows_with_frequent_elements():
    assert ngram_join.choose_level(np.array([2, 2]), 100, 75) == 1
    assert 1 < ngram_join.choose_level(np.array([5000] * 3), 400, 75) < ngram_join.WHOLE
    assert ngram_join.choose_level(np.array([2000] * 26), 100, 75) == ngram_join.WHOLE


def test_jaccard_empty(spark):
    assert ngram_join.near_duplicate_groups(spark.createDataFrame([], EMPTY)).collect() == []


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("ledgerloom.llm.components.FEW", few)
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (50, 100), (7, 7), (200, 201), (201, 150), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {50: 50, 100: 50, 150: 150, 200: 150, 201: 150}


def test_links_are_not_lost_between_different_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = ngram_join.near_duplicate_groups(docs)
    assert sorted(map(tuple, out.drop("n_links").collect())) == groups(rows, 5)
    assert out.where((F.col("n_links") > 0) & (F.col("n_shingles") == 0)).count() == 0
