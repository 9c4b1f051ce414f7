import itertools
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrina import cli
from vitrina.functions import text
from vitrina.operators import near
from vitrina.operators.graph import components


def plain_groups(texts, similarity, words):
    """Smallest id of each text's component, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i:i + words]) for i in range(max(len(w) - words, 0) + 1)} if w else set())
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= (similarity - 1e-9) * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [(i, len(s), top(i)) for i, s in enumerate(sets)]


def invented(seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("abcdefgh", k=k))
    vocabulary = [word(4) for _ in range(60)]
    texts = [None, "", "one", "one", "two words"]
    # Chains of edits, a large group of copies, and texts that share a long passage.
    for _ in range(12):
        own = rng.choices(vocabulary, k=rng.randint(3, 60))
        for _ in range(rng.randint(1, 7)):
            own = list(own)
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    passage = rng.choices(vocabulary, k=30)
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randint(0, 25))) for _ in range(40)]
    texts += [texts[-1]] * 50
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, similarity, words", [(1, 0.75, 5), (2, 0.5, 2)])
def test_groups_equal_those_of_all_pairs(spark, seed, similarity, words):
    texts = invented(seed)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    clashing = rows.select("*", *[F.lit(1).alias(c) for c in ("n", "node", "token", "component", "a", "b", "text")]).repartition(4)
    found = near.similar_groups(clashing, "body", similarity=similarity, words=words)
    assert sorted(map(tuple, found.collect())) == plain_groups(texts, similarity, words)


def test_null_ids_and_no_rows(spark):
    text = "a b c d e f g h"
    rows = spark.createDataFrame([(None, text), (None, text + " i"), (4, text), (None, "z")], "id long, text string")
    assert sorted(map(str, near.similar_groups(rows, "text").collect())) == sorted([
        "Row(id=None, n_shingles=4, group_id=4)", "Row(id=None, n_shingles=5, group_id=4)", "Row(id=4, n_shingles=4, group_id=4)",
        "Row(id=None, n_shingles=1, group_id=None)",
    ])
    assert near.similar_groups(rows.limit(0), "text").count() == 0


def test_components_of_stars_chains_and_rings(spark):
    links = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001), (2001, 2002), (2002, 2000), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(300)}, **{i: 1000 for i in range(1000, 1061)}, **{i: 2000 for i in (2000, 2001, 2002)}}


def test_command(spark, tmp_path):
    rows = [(i, "uno dos tres cuatro cinco seis siete ocho" + (" nueve" if i % 2 else "")) for i in range(6)]
    spark.createDataFrame(rows, "id long, product_description string").write.parquet(str(tmp_path / "products"))
    cli.main(["duplicates", "--products", str(tmp_path / "products"), "--output", str(tmp_path / "groups")], spark)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "groups")).select("group_id").distinct().collect()] == [(0,)]


def test_only_first_members_and_words_leave_a_row(spark, monkeypatch):
    """Neither all runs of a text nor a row for each of them is written or shuffled."""
    kept, plain = {}, near.materialize

    def noted(df, label):
        kept[label] = plain(df, label)
        return kept[label]

    monkeypatch.setattr(near, "materialize", noted)
    texts = invented(3)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    found = near.similar_groups(rows, "body")
    assert sorted(map(tuple, found.collect())) == plain_groups(texts, 0.75, 5)
    assert all("shingles" not in df.columns for df in kept.values()) and "tokens" not in kept
    sizes = [r.n for r in kept["distinct-sets"].collect()]
    assert kept["first-members"].count() == sum(n - math.ceil(0.75 * n) + 1 for n in sizes) < sum(sizes) / 2


def test_sets_of_a_slice_equal_plain_ones():
    texts = [*invented(4), "a", "a b", "b a", "a b c d", "a b c d e", "a a a a a a a", " a  b "]
    held = near._Sets.of(pa.array(texts, pa.string()), 5)
    plain = [n for _, n, _ in plain_groups(texts, 0.75, 5)]
    assert held.sizes.tolist() == plain
    ends, seen = held.ends, {}
    for i, t in enumerate(texts):
        words = (t or "").split()
        runs = frozenset(tuple(words[j:j + 5]) for j in range(max(len(words) - 5, 0) + 1)) if words else frozenset()
        members = frozenset(zip(held.first[ends[i]:ends[i + 1]].tolist(), held.second[ends[i]:ends[i + 1]].tolist(), strict=True))
        assert len(members) == len(runs) and seen.setdefault(members, runs) == runs


def test_plain_texts_are_normalised_alike(spark):
    odd = [None, "", " ", "Ab_c/d-e  f.g\t\nh", "ÀÉ ñ¿x? 12ª", "see https://a.b/c_d e www.x y", "ſ ﬁ Ⅷ İI ǅ", "a b\xa0c", "пан 日本 ①x", "a\x1cb\x85c", "x--y __ z/"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id long, t string").coalesce(1)
    whole = [r.w for r in rows.select("id", text.normalize_text("t").alias("w")).orderBy("id").collect()]
    half = rows.select("id", *text.half_normalized("t")).orderBy("id").toArrow()
    assert text.normalized_rest(half.column("half"), half.column("plain")).to_pylist() == whole
    assert 3 < sum(half.column("plain").to_pylist()) < len(odd)


def test_sets_are_known_by_numbers(spark, monkeypatch):
    """What is shuffled for each member is three numbers."""
    kept, plain = {}, near.materialize
    monkeypatch.setattr(near, "materialize", lambda df, label: kept.setdefault(label, plain(df, label)))
    rows = spark.createDataFrame(list(enumerate(["a b c d e f g h i j", "a b c d e f g h i j k", "x"])), "id long, body string")
    assert near.similar_groups(rows, "body").select("group_id").distinct().count() == 2
    assert {kind for label in ("first-members", "prefixes") for _, kind in kept[label].dtypes} == {"bigint"}
