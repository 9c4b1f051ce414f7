import numpy as np
import pyarrow as pa

from conftest_llm import invented, linked_groups, shingles
from vitrina.llm import minhash
from vitrina.llm.components import components


def compared(docs_of, rows):
    found = {}
    for r in minhash.near_duplicates(docs_of(rows)).collect():
        found.setdefault(r.id, []).append((r.n_shingles, r.component_id))
    return found


def check(docs_of, rows):
    rows = sorted(rows, key=lambda r: r[0])
    sets = [shingles(t) for _, t in rows]
    groups = linked_groups(sets)
    found = compared(docs_of, rows)
    for (doc_id, _), s, g in zip(rows, sets, groups):
        assert (len(s), rows[g][0]) in found[doc_id]
    assert sum(map(len, found.values())) == len(rows)


def test_near_copies_at_all_distances(docs_of):
    rng = np.random.default_rng(5)
    rows, doc_id = [], 0
    for words in (6, 20, 60, 150):
        for _ in range(4):
            base = invented(rng, words)
            for edits in range(0, 12):
                copy = list(base)
                for at in rng.integers(0, words, edits):
                    copy[at] = f"x{rng.integers(0, 30)}"
                rows.append((doc_id, " ".join(copy)))
                doc_id += 7
    check(docs_of, rows)


def test_one_large_group_with_outliers(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "TILE_COLUMNS", 64)
    rng = np.random.default_rng(6)
    base, rows = invented(rng, 80), []
    for i in range(260):
        copy = list(base)
        for at in rng.integers(0, 80, rng.integers(0, 9)):
            copy[at] = f"x{rng.integers(0, 5)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # exact copies
    check(docs_of, rows)


def test_edges(docs_of):
    text = "the same five words and more"
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "two words"), (5, "TWO\twords"), (6, "two words more"), (7, text), (8, text.upper()), (8, text),
        (9, "é " * 9), (10, "É " * 9), (11, " ".join(f"w{i}" for i in range(30_000))), (12, " ".join(f"w{i}" for i in range(30_000)) + " end"),
    ]
    check(docs_of, rows)
    null_id = compared(docs_of, [(None, text), (5, text), (None, "alone in this table it is")])
    assert null_id[5] == [(2, 5)] and sorted(map(str, null_id[None])) == ["(2, 5)", "(2, None)"]
    assert minhash.near_duplicates(docs_of([])).count() == 0
    assert minhash.near_duplicates(docs_of([(1, "a b c d e f")])).count() == 1


def test_one_of_each(docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (3, text), (9, text + " more"), (1, "other words than those are here"), (2, None), (4, ""), (1, "other words than those are here"), (None, "null id null id null id"), (None, "null id null id null id")]
    docs = docs_of(rows)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "None"]


def test_texts_that_share_an_id_or_have_none_stay_apart(docs_of):
    rng = np.random.default_rng(9)
    a, b, c, d, e = (invented(rng, 60, 10_000) for _ in range(5))
    near = lambda words: " ".join([*words, "more"])
    rows = [
        (None, near(a)), (5, " ".join(a)), (None, near(b)), (9, " ".join(b)), (None, " ".join(c)), (None, near(c)),
        (12, " ".join(d)), (12, " ".join(e)), (13, near(d)), (14, near(e)),
    ]
    found = compared(docs_of, rows)
    assert [found[i][0][1] for i in (5, 9, 13, 14)] == [5, 9, 12, 12]
    assert sorted(str(x) for _, x in found[None]) == ["5", "9", "None", "None"]
    assert sorted(x for _, x in found[12]) == [12, 12]
    kept = [(r.doc_id, r.text) for r in minhash.one_of_each(docs_of(rows)).collect()]
    assert len(kept) == 5
    assert sorted(t for i, t in kept if i == 12) == sorted([" ".join(d), " ".join(e)])
    for words in (a, b, c):
        assert sum(t in (" ".join(words), near(words)) for _, t in kept) == 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    base = invented(rng, 400, 10_000)
    copy = base[:320] + invented(rng, 80, 10_000)
    sets, ends = minhash.shingle_sets(pa.array([" ".join(base), " ".join(copy), None]))
    a, b = shingles(" ".join(base)), shingles(" ".join(copy))
    assert list(np.diff(ends)) == [len(a), len(b), 0]
    values = minhash.min_max_signatures(sets, ends)
    assert abs((values[0] == values[1]).mean() - len(a & b) / len(a | b)) < 0.15
    sliced = pa.array(["skip me", " ".join(base)]).slice(1)
    assert (minhash.shingle_sets(sliced)[0] == sets[:ends[1]]).all()


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7), (3, 2), (2, 3)]
    edges += [tuple(int(x) for x in rng.integers(1000, 1100, 2)) for _ in range(70)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
