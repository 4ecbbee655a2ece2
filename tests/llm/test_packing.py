import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm import packing, queries

FILE = "byte_bpe_50k.json"


def texts():
    rng = random.Random(1)
    words = ["hello", "Größe", "naïve", "tokens'll", "<|endoftext|>", "42", "\n\n", "  ", "\x85", "日本語", "don't"]
    out = [None, "", " ", "a", "x" * 5000, "<|endoftext|>"]
    return out + [" ".join(rng.choice(words) for _ in range(rng.randrange(900))) for _ in range(60)]


def test_pieces_and_sequences_round_trip(spark):
    rows = [(i, t, "c") for i, t in enumerate(texts())] + [(None, "no id", "c"), (3, "a", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    seq = 128
    got = packing.pack(docs, FILE, seq_len=seq, group_size=40).collect()
    t = Tokenizer.from_file(public_tokenizers.path(FILE))
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]})
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert mine[0][1] == 0 and sum(m[2] for m in mine) == len(ids)
        assert all(m[2] == seq for m in mine[1:]) and (len(mine) == 1) == (len(ids) <= seq)
        for _, start, length, crc in mine:
            assert crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
    assert len(by_doc[3]) == 2
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= seq
    assert packing.pack(docs.limit(0), FILE).count() == 0


def brute(lengths, caps, weights):
    """Best fit by the least weighted residual norm, over plain lists."""
    bins, order = [], sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        need = (lengths[i], 1, lengths[i] ** 2)
        fit = [b for b in bins if all(c >= n for c, n in zip(b[0], need))]
        if fit:
            best = min(fit, key=lambda b: sum(w * ((c - n) / k) ** 2 for w, c, n, k in zip(weights, b[0], need, caps)))
        else:
            bins.append(best := [list(caps), []])
        best[0] = [c - n for c, n in zip(best[0], need)]
        best[1].append(i)
    return bins


def test_best_fit_equals_brute_force_under_every_capacity():
    rng = np.random.default_rng(3)
    for max_docs, max_cost, rule in ((3, 1e9, "norm"), (50, 4000.0, "norm"), (512, 1e4, "norm"), (3, 5000.0, "dot")):
        lengths = rng.integers(1, 60, 300)
        bins, offsets = packing.best_fit(lengths, seq_len=100, max_docs=max_docs, max_cost=max_cost, rule=rule)
        for b in range(bins.max() + 1):
            mine = np.flatnonzero(bins == b)
            assert lengths[mine].sum() <= 100 and len(mine) <= max_docs
            assert (lengths[mine] ** 2).sum() <= max_cost or len(mine) == 1
            spans = sorted(zip(offsets[mine], lengths[mine]))
            assert [o for o, _ in spans] == np.cumsum([0, *[n for _, n in spans][:-1]]).tolist()
        if rule == "norm":
            want = brute(lengths.tolist(), (100, max_docs, max_cost), (1.0, 0.05, 0.05))
            assert bins.max() + 1 == len(want)


LONG = [" " * 1_000_000, "\n" * 1_000_000, "x" * 1_000_000, "a " * 3 + "\t" * 4000 + "b", "é" * 5000, "<|endoftext|>" * 300, "hello <|endoftext|> world"]


def test_ids_are_those_of_the_tokenizer_as_loaded():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(FILE))
    encode = packing.encoder(public_tokenizers.path(FILE))
    assert encode.fast is not None
    for text in [t or "" for t in texts()] + LONG + ["a<|endoftext|><|endoftext|>b  <|endoftext", " " * 511 + "x" + "y" * 4095]:
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids
    assert encode("hello <|endoftext|> world") == [31373, 220, 50256, 995]
    other = public_tokenizers.path("word_bpe_49k.json")  # another kind of file has no fast form
    assert packing.encoder(other).fast is None
    assert packing.encoder(other)("Some Words") == Tokenizer.from_file(other).encode("Some Words", add_special_tokens=False).ids


def test_query_packs_whole_texts_as_the_contract_says(spark, tmp_path):
    rows = list(enumerate([*texts(), *LONG]))
    spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, lang string, `a.b` int").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path(FILE))
    by_doc, by_sequence = {}, {}
    for r in queries.op9_pack(spark, str(tmp_path)).collect():
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[i])
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1] for m in mine] == [0, *np.cumsum([m[2] for m in mine])[:-1].tolist()]
        assert all(m[2] == 2048 for m in mine[1:]) and sum(m[2] for m in mine) == len(ids)
        for _, start, length, crc in mine:
            assert crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
    for spans in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    tokens = sum(m[2] for pieces in by_doc.values() for m in pieces)
    assert len(by_sequence) <= -(-tokens // 2048) + 1


def test_capacities_that_bind_hold_in_every_sequence(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 9)) for i in range(300)], "doc_id long, text string")
    got = packing.pack(docs, FILE, seq_len=64, max_docs=3, max_cost=200.0, group_size=100).collect()
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append(r.length)
    assert all(len(x) <= 3 and sum(x) <= 64 and (sum(n * n for n in x) <= 200 or len(x) == 1) for x in held.values())
    assert max(map(len, held.values())) == 3 and len(got) == 300
