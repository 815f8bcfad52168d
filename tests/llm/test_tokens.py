import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm.encode import PieceEncoder  # noqa: E402
from tessera.llm.packing import pack, plan_bins  # noqa: E402
from tessera.llm.token_files import BLOCK, decode_blocks, encode_blocks, read_token_files, token_folder, write_token_files  # noqa: E402


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,pieces", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "whole")])
def test_pieces_give_the_library_ids(name, pieces):
    enc, want = PieceEncoder(public_tokenizers.path(name), pieces), library(name)
    alphabet = st.sampled_from(list("aB'st \n\t\x0b\x1c\x85 　 ́éß12,.<|>") + [" the", " ", "  ", "endoftext", "<|endoftext|>", "<|startoftext|>", "Ünd", "Σ", "漢", "~", "×"])
    assert enc.direct == (pieces != "whole")

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(alphabet, max_size=12).map("".join), max_size=6), st.integers(0, 2))
    def same(texts, skipped):
        ids, at = enc.encode(pa.array([None, "a b", *texts], pa.string())[skipped:])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want([None, "a b", *texts][skipped:])

    same()


def test_special_tokens_are_those_of_the_plain_call():
    for name, pieces, special in (("byte_bpe_50k.json", "spaced", 50256), ("word_bpe_49k.json", "words", 49407)):
        ids, _ = PieceEncoder(public_tokenizers.path(name), pieces).encode(pa.array(["one <|endoftext|> two"]))
        assert ids[-2] == special and ids.tolist() == library(name)(["one <|endoftext|> two"])[0]


def test_a_wrongly_named_way_to_cut_falls_back_on_the_library():
    enc = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), "words")
    assert not enc.direct  # it doesn't lower-case


def test_forgotten_pieces_come_back(monkeypatch):
    monkeypatch.setattr("tessera.llm.encode.KEPT_PIECES", 20)
    enc, want = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), "words"), library("word_bpe_49k.json")
    r = np.random.default_rng(3)
    for _ in range(10):
        texts = [" ".join(f"Wort{'abc'[x % 3] * (x % 7)}, {x}" for x in r.integers(0, 60, 30)) for _ in range(5)]
        ids, at = enc.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want(texts)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 4), st.sampled_from([1, 2, 60, 50_257, 2**20, 2**32]), st.floats(0, 0.2))
def test_blocks_round_trip(seed, n, top, odd):
    r = np.random.default_rng(seed)
    ids = r.integers(0, top, n * BLOCK).astype(np.uint32)
    ids[r.random(len(ids)) < odd] = 2**32 - 1
    data, starts = encode_blocks(ids)
    assert (decode_blocks(np.frombuffer(data, np.uint8), starts) == ids).all()


def test_files_hold_every_document(spark, odd_docs):
    folder = token_folder(spark)
    manifest = write_token_files(odd_docs, folder, public_tokenizers.path("byte_bpe_50k.json"), files=3)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(manifest, folder).collect())
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()), key=lambda r: r[0])
    start, want = 0, []
    for (doc, _), ids in zip(rows, library("byte_bpe_50k.json")([t for _, t in rows])):
        ids = [*ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_null_and_repeated_ids_in_files(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "b c"), (3, "d"), (None, None), (1, "e")], "doc_id long, text string")
    folder = token_folder(spark)
    got = sorted(read_token_files(write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), files=2), folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 3, 3]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]


def test_files_of_an_empty_table(spark, odd_docs):
    folder = token_folder(spark)
    manifest = write_token_files(odd_docs.where("false"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    assert read_token_files(manifest, folder).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_holds_each_document_once(counts):
    used: dict[int, int] = {}
    for made, copies in plan_bins(counts, 40):
        assert sum(k * n for k, n in made) <= 40
        for k, n in made:
            used[k] = used.get(k, 0) + n * copies
    assert used == counts


def test_two_documents_replace_the_smallest():
    # greedy fills 10 with 6 + 3 (gap 1); 2 + 2 fill the expanded gap of 4 better than 3
    assert plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == ([(6, 1), (2, 2)], 1)


def test_packing(spark, odd_docs):
    path, cap = public_tokenizers.path("word_bpe_49k.json"), 64
    rows = [r.asDict() for r in pack(odd_docs, path, capacity=cap).collect()]
    docs = odd_docs.select("doc_id", "text").collect()
    want = []
    for r, ids in zip(docs, library("word_bpe_49k.json")([r.text for r in docs])):
        ids = [*ids, 0]
        want += [(r.doc_id, k, s, len(ids[s : s + cap]), zlib.crc32(np.array(ids[s : s + cap], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), cap))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    assert len(bins) <= -(-sum(r["length"] for r in rows) // cap) + 1


def test_packing_an_empty_table(spark, odd_docs):
    assert pack(odd_docs.where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0
