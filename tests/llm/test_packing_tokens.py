from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellweave.llm.packing import fill_gaps, first_fit_decreasing, pack
from cellweave.llm.queries import vocabulary
from cellweave.llm.tokens import PieceEncoder
from cellweave.llm.tokenstore import decode_numbers, encode_numbers, token_spans

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
TEXTS = [None, "", " ", "a", "\n\n x  y\t z 　 w", "it's the <|endoftext|> end", "é ́x ÉCOLE İstanbul ΟΔΟΣ", "word " * 5000, "x" * 9000, "\x1c a \x1f b\x85c", "same text", "same text"]
ENCODERS = {p: (PieceEncoder(p, k), Tokenizer.from_file(p)) for p, k in ((BYTE, True), (WORD, False))}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_librarys_ids(path):
    ours, theirs = ENCODERS[path]
    texts = [x or "" for x in TEXTS]
    for text, ids in zip(texts, ours.batch(texts)):
        assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,á  \x1c<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_pieces_give_the_librarys_ids_for_any_text(text):
    for ours, theirs in ENCODERS.values():
        assert ours.batch([text])[0].tolist() == theirs.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing_equals_a_plain_search(sizes):
    sizes = sorted(sizes, reverse=True)
    room, expected = [], []
    for s in sizes:
        k = next((i for i, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(50)
        room[k] -= s
        expected.append(k)
    assert first_fit_decreasing(sizes, 50) == expected


@given(st.one_of(st.lists(st.integers(1, 2047), min_size=1, max_size=60), st.lists(st.integers(1000, 1400), min_size=20, max_size=60)))
def test_filling_gaps_keeps_every_id_and_saves_bins(sizes):
    sizes = sorted(sizes, reverse=True)
    bins = defaultdict(list)
    for k, b in enumerate(first_fit_decreasing(sizes, 2048)):
        bins[b].append([k, 0, sizes[k]])
    out = fill_gaps(list(bins.values()), 2048)
    assert len(out) <= len(bins) and all(0 < sum(p[2] for p in b) <= 2048 for b in out)
    got = defaultdict(list)
    for k, start, n in (p for b in out for p in b):
        got[k].append((start, n))
    for k, size in enumerate(sizes):
        at = 0
        for start, n in sorted(got[k]):
            assert start == at and n > 0
            at += n
        assert at == size


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "other") for k, t in enumerate(texts)] + [(None, "no id", "other")], "doc_id long, text string, sequence_id string")


def test_packing_holds_every_id_once(spark):
    tok = Tokenizer.from_file(BYTE)
    texts = TEXTS + [f"some words {k} " * (k % 97) for k in range(300)]
    rows = pack(docs(spark, texts), BYTE, group_docs=64).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for k, text in enumerate(texts):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for content in sequences.values():
        at = 0
        for r in sorted(content, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_equal_large_documents_leave_little_padding(spark):
    rows = pack(docs(spark, ["word " * 1100] * 200), BYTE, group_docs=1024).collect()
    assert len({r.sequence_id for r in rows}) <= sum(r.length for r in rows) / 2048 * 1.02 + 2


def test_packing_an_empty_table(spark):
    assert pack(docs(spark, []).where("false"), BYTE).collect() == []


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_number_coding_round_trip(numbers):
    control, data = encode_numbers(np.array(numbers, dtype="<u4"))
    assert len(control) == -(-len(numbers) // 4)
    assert decode_numbers(control, data, len(numbers)).tolist() == numbers


def test_token_files_give_back_every_id(spark):
    tok = Tokenizer.from_file(WORD)
    rows = sorted((r for r in token_spans(docs(spark, TEXTS), WORD).collect()), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *range(len(TEXTS))]
    at = 0
    for r, text in zip(rows, ["no id", *TEXTS]):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc32(ids.tobytes()))
        at += len(ids)
    assert token_spans(docs(spark, []).where("false"), WORD).collect() == []
