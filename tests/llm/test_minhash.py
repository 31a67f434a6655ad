import random
import re

import pytest

from loomseries.llm import components, minhash, nodes

DOCS = "doc_id long, text string, node string, id string, c1 string, part int"


def brute(docs):
    """doc_id -> (set sizes, component), comparing all pairs of sets."""
    sets = []
    for doc_id, text in docs:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        sets.append((doc_id, frozenset(s)))
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = {}
    for d, s in sets:
        if d is not None and s:
            distinct.setdefault(s, []).append(d)
    groups = list(distinct.items())
    for i, (s, ds) in enumerate(groups):
        pairs = [(ds[0], d) for d in ds[1:]]
        for t, es in groups[:i]:
            if min(len(s), len(t)) * 100 >= 75 * max(len(s), len(t)) and 100 * len(s & t) >= 75 * len(s | t):
                pairs.append((ds[0], es[0]))
        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((d is None, d or 0, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(900)]
    line = " ".join(rng.choices(vocabulary, k=14))
    texts = []
    for _ in range(n):
        w = rng.choices(vocabulary, k=rng.choice([3, 8, 30, 90, 200]))
        text = " ".join(w) + ("\n" + line if rng.random() < 0.5 else "")
        texts.append(text)
        for _ in range(rng.choice([0, 0, 0, 1, 3, 12])):
            v = text.split(" ")
            for _ in range(rng.randint(0, max(1, len(v) // 25))):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            texts.append(" ".join(v).replace(" ", rng.choice([" ", "  ", "\t"])).upper() if rng.random() < 0.2 else " ".join(v))
    rng.shuffle(texts)
    return list(enumerate(texts))


def rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "n", "i", "c", 1) for d, t in docs], DOCS)


def test_same_components_as_all_pairs(spark):
    docs = corpus(1, 260)
    assert rows(minhash.near_duplicates(frame(spark, docs))) == brute(docs)


def test_large_groups_go_through_stars_levels_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "LEVELS", 2)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    monkeypatch.setattr(nodes, "HOT", 20)
    monkeypatch.setattr(nodes, "PART_ENTRIES", 200)
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    docs = corpus(2, 60)
    chain = list(base)
    for i in range(90):  # a chain: each is similar to the next ones, the first and the last are not
        for _ in range(1):
            chain[rng.randrange(len(chain))] = str(rng.randrange(10**6))
        docs.append((1000 - i, " ".join(chain)))
    for i in range(150):
        v = list(base)
        for _ in range(rng.randint(1, 3)):
            v[rng.randrange(len(v))] = str(rng.randrange(10**6))
        docs.append((2000 + i, " ".join(v)))
    assert rows(minhash.near_duplicates(frame(spark, docs))) == brute(docs)


def test_odd_rows(spark):
    long = " ".join(str(i % 4000) for i in range(60_000))
    docs = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, "one"), (7, long), (8, long + " more"),
        (None, "one two"), (None, None), (9, "a b c d e"), (9, "a b c d e"), (9, "x y z x y z w"), (10, "A b c d e"), (11, "x y z x y z w"),
        (12, "É a b c d e f"), (13, "é a b c d e f"),
    ]
    assert rows(minhash.near_duplicates(frame(spark, docs))) == brute(docs)
    assert minhash.near_duplicates(frame(spark, []).select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(7, 100), (101, 100), (5, None), (200, 201)]])
def test_components(spark, links):
    found = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for a, b in links if b is not None for x in (a, b)}
    for _ in root:
        for a, b in links:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root


def test_components_compute_their_links_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)] + [(99, 99)], "a long, b long")
    found = components.components(links.mapInArrow(seen, "a long, b long")).collect()
    assert len(found) == 41
    assert read.value == 21


def family(spark, docs, main=()):
    """Of some docs (id, text), one family, as ``Join.in_families`` has them: the join, its members and their sets."""
    join = minhash.Join(spark.createDataFrame(docs, "doc_id long, text string"), None)
    members = spark.createDataFrame([(d, min(main) if d in main else d, 0, d not in main) for d, _ in docs], "id long, part long, family long, rest boolean")
    return join, members, join.sets(members.select("id"))


@pytest.mark.parametrize("block", [1024, 4])
def test_a_common_line_makes_no_pairs_in_a_family(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PIECE", 64)
    rng = random.Random(8)
    line = " ".join(f"common{i}" for i in range(24))
    docs = [(i, line + " " + " ".join(str(rng.randrange(10**9)) for _ in range(12))) for i in range(300)]
    near = [(1000 + i, docs[0][1].rsplit(" ", 1 + i % 2)[0] + f" other{i}") for i in range(9)]
    alike = {(min(a, b), max(a, b)) for a in (0, *range(1000, 1009)) for b in (0, *range(1000, 1009)) if a != b}
    for main in ((), (1000, 1001, 1002, 1003, 1004, 1005)):
        join, members, sets = family(spark, docs + near, main)
        found = [(r.a, r.b) for r in join.in_prefixes(members, sets).collect()]
        wanted = {(a, b) for a, b in alike if not (a in main and b in main)}
        assert len(found) == len(set(found))
        assert wanted <= set(found)
        assert len(found) <= 2 * len(alike)


@pytest.mark.parametrize("block", [1024, 5])
def test_no_link_of_a_family_is_missed(spark, monkeypatch, block):
    """Sets around the threshold: the links that prefixes, signatures and whole sets leave are those of all pairs."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PIECE", 100)
    rng = random.Random(9)
    base = [str(rng.randrange(10**6)) for _ in range(150)]
    docs = []
    for i in range(130):
        w = base[: rng.choice([5, 8, 20, 60, 150])]
        for _ in range(rng.choice([0, 1, 2, 4])):
            w = [*w[: (k := rng.randrange(len(w)))], f"x{rng.randrange(40)}", *w[k + 1 :]] + [f"y{rng.randrange(40)}"] * rng.randint(0, 2)
        docs.append((i, " ".join(w)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in docs}
    main = set(range(0, 130, 3))
    join, members, found = family(spark, docs, main)
    signs = {r.id: r for df in [found.mapInArrow(minhash._signatures, "id long, n long, bits array<long>")] for r in df.collect()}
    assert all(signs[d].n == len(x) for d, x in sets.items())
    links = {(a, b) for a in sets for b in sets if a < b and not (a in main and b in main) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    pairs = {(r.a, r.b) for r in join.in_prefixes(members, found).collect()}
    assert len(links) > 50
    assert links <= pairs
    rows = spark.createDataFrame([(a, b, signs[a].n, signs[b].n, list(signs[a].bits), list(signs[b].bits)) for a, b in pairs],
                                 "a long, b long, n1 long, n2 long, s1 array<long>, s2 array<long>")
    left = rows.where(minhash._may_be_linked(*(rows[c] for c in ("n1", "n2", "s1", "s2"))))
    assert {(r.a, r.b) for r in join.confirmed(left.select("a", "b"), found).collect()} == links
