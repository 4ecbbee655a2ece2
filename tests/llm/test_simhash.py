import itertools
import random

import pytest
import xxhash

from factloom.llm import simhash


def brute_print(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, near):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(ids, 2):
        if near(prints[i], prints[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_matches_definition():
    for text in [None, "", " \t\n", "one", "One two", "a b c", "A b\tc d É é\x0be f g h " * 30, "x y z"]:
        assert simhash.fingerprint(text)[0] == brute_print(text)


def joined(pairs, nodes):
    """The partition of the nodes that pairs make, whatever pairs make it."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize(("crowd", "hot"), [(1, 2), (2, 4), (5, 4096), (4096, 4096)])
def test_links_and_components_equal_brute_force(spark, crowd, hot):
    rng = random.Random(5)
    prints = {}
    for base in range(12):
        fp = rng.getrandbits(64)
        for k in range(12):
            for _ in range(rng.randrange(3)):
                fp ^= 1 << rng.randrange(64)
            prints[base * 100 + k] = fp
    dense = rng.getrandbits(64)  # a crowd that shares a half and differs in a few bits
    for k in range(60):
        prints[5000 + k] = dense ^ (k * 7)
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in prints.items()}
    classes = spark.createDataFrame([(f,) for f in set(signed.values())], "fp long")
    got = {tuple(sorted(r)) for r in simhash.links(classes, 2, hot, crowd=crowd).collect()}
    values = sorted(set(signed.values()))
    want = {(a, b) for a, b in itertools.combinations(values, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want if crowd == 4096 else got <= want
    assert joined(got, values) == joined(want, values)


@pytest.mark.parametrize("bits", [1, 5, 7])
def test_other_distances_with_a_size_ratio(spark, bits):
    rng = random.Random(bits)
    rows = {}
    for _ in range(15):
        fp, size = rng.getrandbits(64), rng.randrange(1, 500)
        for _ in range(8):
            g = fp
            for _ in range(rng.randrange(bits + 2)):
                g ^= 1 << rng.randrange(64)
            rows[g - (1 << 64) if g >> 63 else g] = max(1, int(size * rng.uniform(0.7, 1.3)))
    classes = spark.createDataFrame(list(rows.items()), "fp long, size long")
    want = {
        (a, b)
        for a, b in itertools.combinations(sorted(rows), 2)
        if bin((a ^ b) & (2**64 - 1)).count("1") <= bits and min(rows[a], rows[b]) >= 0.8 * max(rows[a], rows[b])
    }
    for crowd, hot in ((2, 3), (2, 4096), (4096, 4096)):
        got = {tuple(sorted(r)) for r in simhash.links(classes, bits, hot, 0.8, crowd).collect()}
        assert got == want if crowd == 4096 else got <= want
        assert joined(got, rows) == joined(want, rows)


def test_documents_with_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here today " * 8
    rows = [
        (3, text, "x"), (1, text.upper(), None), (2, None, "x"), (7, "", "y"), (4, " \n\t ", "y"),
        (5, "word", "y"), (6, "Word", "y"), (6, "Word", "y"), (None, text, "z"), (9, text * 300, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {r[0]: brute_print(r[1]) for r in rows if r[0] is not None}
    want = brute_components(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [want[3]]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_deduplicate_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(300))
    near = text.replace("w150", "changed")
    rows = [(5, text, "a"), (2, near, "b"), (2, near, "b"), (9, "other words entirely", "c"), (None, text, "d"), (None, "alone here", "e"), (None, "elsewhere", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = simhash.deduplicate(docs, max_bits=7, ratio=0.8)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([rows[1], rows[3], rows[5], rows[6]], key=str)


def test_links_of_fingerprints_are_only_candidates(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for base in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for k, changes in enumerate((0, 0, 2, 5, 9, 14)):
            mine = list(words)
            for at in rng.sample(range(200), changes):
                mine[at] = "x"
            rows.append((base * 10 + k, " ".join(mine)))
    rows += [(1000 + k, rows[0][1] + f" end{k}") for k in range(40)]  # a crowd of one fingerprint or few
    sets = {i: simhash.shingle_set(t) for i, t in rows}
    prints = {i: brute_print(t) for i, t in rows}
    alike = lambda i, j: simhash.similarity(sets[i], sets[j]) >= 0.8
    want = brute_components({i: i for i in sets}, lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 11 and alike(i, j))
    loose = brute_components(prints, lambda a, b: bin(a ^ b).count("1") <= 11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (4, 4096):
        got = simhash.near_duplicates(docs, max_bits=11, ratio=0.8, similar=0.8, crowd=crowd).collect()
        assert {r.doc_id: r.component_id for r in got} == want
    assert want != loose
    kept = simhash.deduplicate(docs, max_bits=11, ratio=0.8, similar=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_deduplicate_moves_nothing_else_and_changes_no_column(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(100))
    extra = ["__id", "__hash", "key", "digest", "maybe", "a.b", "place", "o0", "FP"]
    cells = list(range(len(extra)))
    rows = [(i, text if i % 3 else " ".join(f"v{i * 1000 + k}" for k in range(80)), *cells) for i in range(1, 60)]
    rows += [(1, text, *[c + 1 for c in cells]), (1, text, *cells)]  # rows that are equal but for other columns
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in extra))
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    for limit in (1 << 20, 0):  # few that go are handed out; many are found by a bit map
        monkeypatch.setattr(simhash, "fits", lambda df, limit=limit: bool(limit))
        kept = simhash.deduplicate(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
        assert [tuple(r) for r in kept.filter("doc_id = 1").collect()] == [(1, text, *cells)]


def test_no_link_is_lost_beyond_hubs_and_in_crowds(spark):
    """Texts whose fingerprint is that of what they repeat, in families of two that differ in one word: those of
    the first kind share one fingerprint, those of the second make a crowd of linked fingerprints."""
    rng = random.Random(8)
    rows = []
    for kind, (base, times, families) in enumerate((("a b c d e ", 300, 30), ("p q r s t ", 12, 60))):
        for family in range(families):
            tail = [f"w{rng.randrange(10**6)}" for _ in range(60)]
            for k in range(2):
                rows.append((1000 * kind + 10 * family + k, base * times + " ".join([*tail[:-1], f"last{k}"])))
    sets = {i: simhash.shingle_set(t) for i, t in rows}
    prints = {i: brute_print(t) for i, t in rows}
    assert len({prints[i] for i in prints if i < 1000}) == 1 and len({prints[i] for i in prints if i >= 1000}) > 32
    near = lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 11
    assert len({r for i, r in brute_components(prints, lambda a, b: bin(a ^ b).count("1") <= 11).items()}) < 40
    want = brute_components({i: i for i in sets}, lambda i, j: near(i, j) and simhash.similarity(sets[i], sets[j]) >= 0.8)
    assert len(set(want.values())) <= 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd, hot in ((4, 16), (32, 4096)):
        got = simhash.near_duplicates(docs, max_bits=11, ratio=0.8, similar=0.8, crowd=crowd, hot=hot).collect()
        assert {r.doc_id: r.component_id for r in got} == want
    x, y = sets[0], sets[10]
    bits = bin(int.from_bytes(simhash.sketch(x)) ^ int.from_bytes(simhash.sketch(y))).count("1")
    assert 0 < bits <= len(x ^ y)
