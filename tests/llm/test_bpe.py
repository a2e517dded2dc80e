import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayline.llm.bpe import Classes, Encoder, Spec, decode_ids, encode_texts, split_words
from wayline.llm.lexicon import Lexicon, cut_for, minimal_states
from wayline.llm.packing import default_tokenizer
from wayline.llm.queries import op12_lexicon_bpe

PATH = default_tokenizer()
OWN = Tokenizer.from_file(PATH)
SPEC, CLASSES = Spec(PATH), Classes(PATH)
FREQUENT = [" the", "the", " a", "a", "'s", " ", "\n", " don", "é", "x" * 40, "日本", "12", "!?"]
ENCODER = Encoder(SPEC, CLASSES.table(), Lexicon.compile({w.encode(): SPEC.merge(w.encode()) for w in FREQUENT}))
PIECES = ["a", "The", "the", "don't", "'s", "'S", "''", "'re", "'ve", "'l", "'ll", "x", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "é", "ß.", "1", "12", "²", "!?", "<|endoftext|>", "<|endof", "日本", "\U0001f600", "́", "Ᲊ", "Ƛ", "\r", "\x00"]


def encode(texts):
    raw = [t.encode() for t in texts]
    ids, to = ENCODER.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    return [ids[a:z].tolist() for a, z in zip(to[:-1], to[1:], strict=True)]


def want(text):
    return OWN.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), min_size=1, max_size=5))
def test_ids_equal_the_tokenizer(texts):
    assert encode(texts) == [want(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert encode([text, "", text]) == [want(text), [], want(text)]


def test_classes_equal_the_tokenizer_for_every_assigned_block():
    r = random.Random(0)
    table, split = CLASSES.table(), OWN.pre_tokenizer.pre_tokenize_str
    for c in [*range(0x300), *(c for c in r.sample(range(0x300, 0x110000), 5000) if not 0xD800 <= c < 0xE000)]:
        joins = [len(split(by + chr(c) + by)) == 1 for by in "a1!"]
        assert table[c] == (joins.index(True) if any(joins) else 3), hex(c)


def test_long_words_merge_in_order_of_rank():
    for word in ("ab" * 3000, "x" * 5001, "abcdefghijklmnopqrstuvwxyz" * 40, "日本語" * 400):
        assert SPEC.merge(word.encode()) == want(word)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=20))
def test_lexicon_is_minimal_and_exact(words, others):
    entries = {w: list(w[:2]) for w in words}
    lexicon = Lexicon.compile(entries)
    ordered = sorted(words)
    asked = ordered + others
    raw, ends = np.frombuffer(b"".join(asked), np.uint8), np.cumsum([len(w) for w in asked])
    starts = ends - np.array([len(w) for w in asked], int)
    numbers = lexicon.numbers(raw, starts, ends)
    assert numbers[: len(ordered)].tolist() == list(range(len(ordered)))
    for w, n in zip(asked, numbers.tolist(), strict=True):
        assert (ordered[n] == w and lexicon.ids[lexicon.first[n] : lexicon.first[n + 1]].tolist() == entries[w]) if n >= 0 else w not in words
    # as many states as there are different sets of endings
    beginnings = {w[:i] for w in words for i in range(len(w) + 1)} | {b""}
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in beginnings}
    assert len(minimal_states(ordered)) == len(endings)


def test_lexicon_from_a_file(tmp_path):
    made = Lexicon.compile({b"ab": [1, 2], b"b": [3], b"": []})
    (tmp_path / "x").write_bytes(made.to_bytes())
    back = Lexicon.mapped(str(tmp_path / "x"))
    assert isinstance(back.base.base, np.memmap) and b"ab" in back and b"b" in back and b"a" not in back
    assert back.to_bytes() == made.to_bytes()


def test_cut_keeps_whole_bins():
    assert cut_for([(1, 10), (5, 3), (7, 2)], 5) == 5
    assert cut_for([(1, 10), (5, 3), (7, 2)], 4) == 7
    assert cut_for([(1, 10), (7, 2)], 1) is None and cut_for([], 5) is None
    assert cut_for([(1, 10), (7, 2)], 100) == 1


@pytest.mark.parametrize("words", [0, 3, 65_536])
def test_texts_and_back(spark, words):
    r = random.Random(1)
    texts = [None, "", " ", "<|endoftext|> <|endoftext|>", "a" * 20_000, "word " * 30_000, *("".join(r.choices(PIECES, k=30)) for _ in range(60))]
    rows = [(i if i % 7 else None, t, "id", [1]) for i, t in enumerate(texts)] * 2
    out = encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded array<int>").repartition(3), words=words)
    assert out.columns == ["doc_id", "ids"]
    found = [(r.doc_id, r.same, r.decoded) for r in decode_ids(out.withColumn("same", out.ids)).where("doc_id is not null").collect()]
    assert len(found) == sum(i is not None for i, *_ in rows)
    expected = {i: t or "" for i, t, _, _ in rows if i is not None}
    assert {i for i, _, _ in found} == set(expected)
    assert all(ids == want(expected[i]) and text == expected[i] for i, ids, text in found)
    nulls = sorted(x.ids for x in out.where("doc_id is null").collect())
    assert nulls == sorted(want(t or "") for i, t, _, _ in rows if i is None)


def test_no_rows_and_odd_ids(spark):
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 70000, -5, 64]), (4, [171, 64])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.decoded) for r in decode_ids(odd).collect()) == [(1, ""), (2, ""), (3, "a"), (4, OWN.decode([171, 64], skip_special_tokens=False))]
    with pytest.raises(ValueError):
        decode_ids(odd.withColumn("decoded", odd.doc_id))


def test_query_equals_the_library(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op12_lexicon_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = want(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(OWN.decode(ids, skip_special_tokens=False)))


def test_words_do_not_cross_texts():
    raw = b"a a"
    starts, ends, first, _ = split_words(np.frombuffer(raw, np.uint8), np.array([0, 2, 3]), CLASSES.table())
    assert [raw[a:z] for a, z in zip(starts, ends, strict=True)] == [b"a", b" ", b"a"] and first.tolist() == [0, 2, 3]
