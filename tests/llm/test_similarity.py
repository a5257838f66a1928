"""Near-duplicate documents against brute force: sizes, components, hot groups, chains, similarities just above and below the bound."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablepact.llm import similarity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
RANDOM = random.Random(5)


def words(n, pool=400):
    return " ".join(f"w{RANDOM.randrange(pool)}" for _ in range(n))


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def test_near_duplicates(spark):
    texts = [None, "", "One two", "one TWO"]
    for _ in range(6):
        base = words(300, 5000).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(RANDOM.randrange(0, 8)):
                copy[RANDOM.randrange(300)] = "edit"
            texts.append(" ".join(copy))
    RANDOM.shuffle(texts)
    sizes, roots = brute_components(texts)
    got = similarity.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), small=8).orderBy("doc_id").collect()
    assert [r.n_shingles for r in got] == sizes
    assert [r.component_id for r in got] == roots and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_of_a_long_chain(spark):
    order = RANDOM.sample(range(10_000), 500)
    links = spark.createDataFrame([*zip(order, order[1:]), (20_001, 20_000)], "a long, b long")
    got = {r.id: r.component for r in similarity.components(links).collect()}
    assert got == {i: min(order) for i in order} | {20_000: 20_000, 20_001: 20_000}


def edited(base, n, every=6):
    """A copy with n words replaced, far enough apart that each takes five shingles out."""
    copy = list(base)
    for at in RANDOM.sample(range(4, len(base) - 4, every), n):
        copy[at] = f"e{RANDOM.randrange(10**9)}"
    return copy


def components_of(spark, texts, **options):
    got = similarity.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options)
    return [r.component_id for r in got.orderBy("doc_id").collect()]


@pytest.mark.parametrize("chunk", [2048, 40])
def test_a_large_group_of_alike_but_mostly_unlinked_texts(spark, chunk):
    """Copies of one text that are about as similar as the bound: some pairs are linked, most aren't, and all share their nodes."""
    base, texts = words(304, 5000).split(), []
    for k in range(160):
        texts.append(edited(base, 3 + k % 3))
    texts += [edited(texts[k], 4) for k in range(0, 160, 4)]
    texts = [" ".join(t) for t in texts]
    RANDOM.shuffle(texts)
    _, roots = brute_components(texts)
    assert len(set(roots)) > 20
    assert components_of(spark, texts, small=16, chunk=chunk) == roots


def test_a_large_group_of_near_copies_does_not_branch_below_the_roots(spark, monkeypatch):
    """Its classes are linked with a central one at the first level; classes that aren't are still held against all of them."""
    base, branched, branch = words(304, 5000).split(), [], similarity.branch

    def counted(rows, *, roots=0, percent):
        branched.append(0 if roots else rows.count())
        return branch(rows, roots=roots, percent=percent)

    monkeypatch.setattr(similarity, "branch", counted)
    texts = [edited(base, 1) for _ in range(150)]
    texts += [edited(texts[k], 9) for k in range(3)]  # linked with one copy each, or with none
    texts += [edited(t, 1) for t in texts[-3:]] + [words(304, 5000) for _ in range(30)]
    texts = [" ".join(t) if isinstance(t, list) else t for t in texts]
    RANDOM.shuffle(texts)
    _, roots = brute_components(texts)
    assert components_of(spark, texts, small=32) == roots
    assert sum(branched) == 0


def test_a_chain_of_texts_in_random_order(spark):
    """Each is linked to the next alone, so its 400 links join all of them, however ids lie along it."""
    chain = [words(304, 5000).split()]
    for k in range(400):
        step = list(chain[-1])
        for at in range(4 + 60 * (k % 5), 4 + 60 * (k % 5) + 24, 6):
            step[at] = f"s{k}-{at}"
        chain.append(step)
    texts = [" ".join(t) for t in chain]
    RANDOM.shuffle(texts)
    _, roots = brute_components(texts)
    assert set(roots) == {0} and set(components_of(spark, texts)) == {0}


def test_groups_are_bounded_and_hold_every_pair_once(spark):
    n, chunk = 300, 32
    classes = spark.createDataFrame([(i, 100 if i else 10_000) for i in range(n)], "id long, n_shingles long")
    nodes = spark.createDataFrame([(7, i, n) for i in range(n)] + [(-5, i, 40) for i in range(40)] + [(9, 0, 2), (9, 1, 2)], "node long, id long, n long")
    for linked in (2, 200):
        labels = spark.createDataFrame([(i, 0) for i in range(linked)], "id long, component long")
        groups = {}
        for r in similarity.dealt(nodes, classes, labels, chunk, 1 << 30).collect():
            groups.setdefault((r.node, r.i, r.j), []).append((r.own, r.id))
        assert max(map(len, groups.values())) <= 2 * chunk and {g[0] for g in groups} == ({7, -5} if linked < 40 else {7})
        pairs = []
        for (node, i, j), members in groups.items():
            own = np.array([o for o, _ in members])
            for k, others in similarity.sides(own, i, j):
                pairs += [tuple(sorted((members[k][1], members[m][1]))) for m in others.tolist() if node == 7]
        assert len(pairs) == len(set(pairs))
        assert {(i, j) for i in range(n) for j in range(max(i + 1, linked), n)} <= set(pairs)
    heavy = similarity.dealt(nodes, classes, labels.where("id < 2"), 2048, 20_000).groupBy("node", "i", "j").count()
    assert heavy.where("node = 7").count() > 10  # few classes, but many bytes


def test_links_of_a_group_are_fewer_than_its_members(spark):
    import pyarrow as pa

    hashes = similarity.WordHashes()
    texts = [edited(words(300).split(), 0)]
    texts += [edited(texts[0], 1) for _ in range(60)]
    rows = pa.table({"node": [1] * 61, "i": [0] * 61, "j": [0] * 61, "id": list(range(61)), "component": list(range(61)), "own": [0] * 61, "hashes": [similarity.shingles(" ".join(t), hashes).tobytes() for t in texts]})
    links = similarity.joining(rows, 85)
    assert links.num_rows == 60


def test_sketches_rarely_drop_a_pair_at_the_bound():
    """The exact chance that fewer coordinates agree than are asked for."""
    for percent in (80, 85):
        p = percent / 100 + (1 - percent / 100) / 256
        for n, least in zip((similarity.SKETCH, similarity.TOKENS), similarity.least_agreeing(percent)):
            below = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least))
            assert below < 3e-5


def test_intermediate_tables_are_deleted(spark):
    from tablepact.llm import common

    before = set(common._written)
    texts = [words(50) for _ in range(20)]
    similarity.one_of_each(spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")).collect()
    assert len(set(common._written) - before) <= 3


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, an id with two texts, clashing names, one very long text, an empty table."""
    long = words(120_000, 90_000)
    rows = [(1, "a b c d e f", 0, 0, "x"), (1, "a b c d e f", 0, 0, "x"), (2, "A B C D E F", 1, 1, "y"), (None, "a b c d e f", 2, 2, "z"), (None, None, 3, 3, None), (3, None, 4, 4, None), (4, "", 5, 5, ""), (5, "other words than those", 6, 6, "v"), (5, "a b c d e f", 7, 7, "v"), (8, long, 8, 8, "w"), (9, long + " tail", 9, 9, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, key long, row string")
    got = sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in similarity.near_duplicates(df).collect())))
    ws = long.split()
    n = len({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)})
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, True), (None, 0, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (5, 2, 1, False), (8, n, 8, True), (9, n + 1, 8, False)]
    assert got == sorted(map(repr, want))
    kept = similarity.one_of_each(df)
    assert kept.columns == df.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [1, 3, 4, 5, 8, None, None]))
    empty = df.limit(0)
    assert similarity.near_duplicates(empty).count() == similarity.one_of_each(empty).count() == 0


def test_near_copies_between_80_and_85_percent(spark):
    import corpus_pipeline

    assert similarity.trees_of(80) > similarity.trees_of(85) and similarity.least_agreeing(80) < similarity.least_agreeing(85)
    texts, want = [], set()
    for k in range(40):
        base = words(304, 5000).split()
        copy = list(base)
        for at in range(9, 9 + 6 * (5 + k % 2), 6):
            copy[at] = "edit"
        x, y = ({tuple(w[i : i + 5]) for i in range(300)} for w in (base, copy))
        assert 80 * len(x | y) <= 100 * len(x & y) < 85 * len(x | y)
        texts += [" ".join(base), " ".join(copy)]
        want.add(2 * k)
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want
    got = similarity.near_duplicates(docs, percent=80, small=4).collect()
    assert {r.doc_id for r in got if r.kept} == want


