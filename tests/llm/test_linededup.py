import collections
import hashlib
import random

from factloom.llm import linededup

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    holders = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(WHITE).translate(lower)
            if len(key) >= min_chars:
                holders[key].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            ids = holders.get(line.strip(WHITE).translate(lower), set())
            keeper = max((i for i in ids if i is not None), default=None)
            if len(ids) < min_docs or doc_id == keeper:
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    hot = "This passage is shared by very many documents of the set, é"
    edge = "é" * 39 + "x"  # 40 code points
    short = "é" * 39  # 39, though over 40 bytes
    out = [(i, f"{hot}\nown line {i} that is long enough to be compared with others\n \t{hot.upper() if i % 2 else hot}\r") for i in range(12)]
    out += [(100 + i, f"{edge}\n{short}\n\n{edge if i < 4 else 'tail'}") for i in range(5)]
    out += [(200 + i, "a line found in exactly four documents of this set only") for i in range(4)]
    out += [(300, None), (301, ""), (302, "\n\n"), (None, hot), (303, (hot + "\n") * 5000), (5, out[5][1])]
    return out


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, lines string, digest int")
    got = linededup.deduplicate(docs, counts=True)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()), key=str)
    assert found == brute(rows())
    assert linededup.deduplicate(docs.limit(0)).count() == 0


def digests(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in frame.collect()), key=str)


def test_passes_and_handed_out_keys_do_not_change_the_rows(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    want = brute(rows())
    # a filter of one segment a pass; keys too many to hand out; both, and a bit map of ids that is full
    for options in ({"max_filter_bytes": 8, "segment_bits": 64}, {"max_keys_bytes": 0}, {"max_filter_bytes": 8, "segment_bits": 64, "max_keys_bytes": 1}):
        assert digests(linededup.deduplicate(docs, counts=True, **options)) == want


def test_filters_grow_with_the_corpus(spark):
    """Four times as many lines as one handed-out filter has room for: hardly more suspects than repeats."""
    rng = random.Random(5)
    lines = ["".join(rng.choices("abcdefgh", k=48)) for _ in range(9000)]
    docs = spark.createDataFrame([(i, lines[i]) for i in range(9000)] + [(10000 + i, lines[i]) for i in range(100)], "doc_id long, text string")
    room = {"segment_bits": 1 << 12, "max_filter_bytes": 9000 * linededup.BITS_PER_KEY // 8 // 4}
    found = linededup.suspected(docs, **room)
    assert found.select("digest").distinct().count() <= 100 + 9000 // 50
    repeated = {linededup.digest(x.encode()) for x in lines[:100]}
    assert repeated <= {bytes(r.digest) for r in found.collect()}
    assert linededup.repeated_keys(found, 2).count() == 100


def test_odd_column_names(spark):
    extra = ["__lost", "__lost_id", "lost", "done", "own", "these", "a.b", "Digest", "t`x"]
    names = ", ".join(f"`{c.replace('`', '``')}` long" for c in extra)
    docs = spark.createDataFrame([(i, t, *range(len(extra))) for i, t in rows()], f"doc_id long, text string, {names}")
    for options in ({}, {"max_keys_bytes": 0}):
        got = linededup.deduplicate(docs, counts=True, **options)
        assert got.columns[: len(docs.columns)] == docs.columns
        assert all(tuple(r[c] for c in extra) == tuple(range(len(extra))) for r in got.collect())
        assert digests(got) == brute(rows())
