"""Near copies: one document of each class stays, by the similarity of whole texts."""

import random
from collections import Counter

import numpy as np

from geoframe.llm import simhash


def words(n, seed):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_unlinked_classes_with_the_same_or_no_id_all_stay(spark):
    rows = [(None, words(80, i)) for i in range(6)] + [(7, words(80, 100)), (7, words(80, 101)), (7, words(80, 102)), (8, words(80, 102))]
    docs = spark.createDataFrame(rows + [(None, words(80, 0)), (7, words(80, 100))], "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    assert sorted(got, key=str) == sorted(rows[:-1], key=str)


def test_odd_rows(spark):
    rows = [(1, None, 1.5), (2, "", 1.5), (3, "  ", 1.5), (4, "One", 1.5), (5, "one", 2.5), (6, "two words", 1.5), (6, "two words", 1.5), (9, words(30_000, 1), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t double")
    got = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    assert Counter(got) == Counter([rows[0], rows[3], rows[5], rows[7]])
    assert simhash.one_of_each(docs.limit(0)).columns == docs.columns and simhash.one_of_each(docs.limit(0)).count() == 0


def test_near_copies_against_all_pairs(spark):
    rnd, rows = random.Random(4), []
    for i in range(300):
        base = words(rnd.randint(20, 300), i).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 6])):  # some words changed, a part left out, or words put in
            w = list(base)
            for _ in range(rnd.randint(1, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(1000)}"
            if rnd.random() < 0.3:
                del w[: len(w) // 20]
            rows.append((len(rows), " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    group, pairs = list(range(len(rows))), []

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                pairs.append((j, i))
                group[max(root(i), root(j))] = min(root(i), root(j))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    # Each class keeps its smallest document, so nothing goes that is in no class; of those to go nine in ten do.
    assert {root(i) for i in range(len(rows))} <= kept
    gone, to_go = len(rows) - len(kept), sum(root(i) != i for i in range(len(rows)))
    assert to_go > 250 and gone >= 0.9 * to_go


def test_trees_against_all_pairs():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = np.unique(centres[rng.integers(0, 60, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)))
    rng.shuffle(values)
    group = np.sort(rng.integers(0, 3, len(values)))
    for radius in (0, 1, 3, 5):
        want = {(i, j, int(values[i] ^ values[j]).bit_count()) for j in range(len(values)) for i in range(j) if group[i] == group[j] and int(values[i] ^ values[j]).bit_count() <= radius}
        got = [x for a, b, d, _ in simhash.BKTrees(values, group).pairs(radius) for x in zip(a.tolist(), b.tolist(), d.tolist())]
        assert len(got) == len(set(got)) and set(got) == want
        a, b, visited = simhash.forest_of(values, group, radius)
        assert visited < len(values) ** 2 and len(a) == len(set(zip(a.tolist(), b.tolist())))
        # The forest is as short as Kruskal's, and links the same.
        parent, least = list(range(len(values))), []

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j, d in sorted(want, key=lambda x: x[2]):
            if find(i) != find(j):
                parent[find(j)] = find(i)
                least.append(d)
        chosen = [int(values[i] ^ values[j]).bit_count() for i, j in zip(a.tolist(), b.tolist())]
        assert sorted(chosen) == sorted(least) and all(find(i) == find(j) for i, j in zip(a.tolist(), b.tolist()))
