import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayline.llm.packing import default_tokenizer, encoder, pack_documents, pack_vectors

OWN = Tokenizer.from_file(default_tokenizer())


def ids(text):
    return OWN.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", "don't", " ", " ", "\n", "\t", " ", " ", "é", "ß.", "12", "!?", "\x1c", "<|endoftext|>", "日本", "\r"]), max_size=25).map("".join))
def test_ids_equal_the_tokenizer(text):
    assert encoder(default_tokenizer())(text) == array("I", OWN.encode(text, add_special_tokens=False).ids).tobytes()


def check(rows, texts, limit=2048):
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length, r.loss_tokens))
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in seqs.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit and len(parts) <= 64
    for doc_id, text in texts.items():
        own, at = ids(text), 0
        for start, length, crc, n in sorted(docs[doc_id]):
            assert start == at and n == len(own)
            assert zlib.crc32(array("I", own[start : start + length]).tobytes()) == crc
            at += length
        assert at == len(own)
    return sum(x[1] for p in seqs.values() for x in p) / (limit * len(seqs))


def test_every_id_once_and_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used = check(pack_documents(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert used > 0.98


def test_odd_rows(spark):
    rows = {1: None, 2: "", 3: " \n\t ", 4: "word " * 30000, 5: "a<|endoftext|>b"}
    docs = spark.createDataFrame([(k, v, 1) for k, v in rows.items()], "doc_id long, text string, length int")
    check(pack_documents(docs).collect(), rows)
    twice = spark.createDataFrame([(7, "x y"), (7, "x y"), (None, "z")], "doc_id long, text string")
    assert pack_documents(twice).count() == 3 and pack_documents(twice.limit(0)).count() == 0


def test_limits_hold_in_every_dimension():
    rng = np.random.default_rng(2)
    demands = np.stack([rng.integers(1, 100, 3000), np.ones(3000, int), rng.integers(0, 90, 3000)], axis=1)
    limits = np.array([200, 4, 120])
    bins = pack_vectors(demands, limits)
    sums = np.stack([np.bincount(bins, demands[:, d]) for d in range(3)], axis=1)
    assert (sums <= limits).all() and len(sums) < 1.15 * (demands / limits).sum(axis=0).max()
    with pytest.raises(ValueError):
        pack_vectors(np.array([[201, 1, 0]]), limits)


def test_masked_instruction_data_under_a_binding_loss_limit(spark):
    """Dialogues whose prompt bears no loss: all three limits hold, and each of them binds somewhere."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("text is not null").orderBy("conv_id", "turn").collect()
    talks = {}
    for r in turns:
        talks.setdefault(r.conv_id, []).append(r.text)
    rows = [(k, " ".join(t), len(t[0]) if k % 3 else 10 ** 6) for k, t in talks.items()] + [(10**6, "word " * 3000, 0), (10**6 + 1, "word " * 3000, 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mute int")
    texts, prompts = {d: t for d, t, _ in rows}, {d: t[:m] for d, t, m in rows}
    for tokens, segments, loss in ((512, 64, 200), (2048, 1, 2048)):
        out = pack_documents(docs, tokens=tokens, segments=segments, loss_tokens=loss, prompt=docs.mute).collect()
        sums = {}
        for r in out:
            first = max(1, len(ids(prompts[r.doc_id])) - 1)
            assert r.loss_tokens == sum(i >= first for i in range(r.start, r.start + r.length))
            s = sums.setdefault(r.sequence_id, [0, 0, 0])
            for i, v in enumerate((r.length, 1, r.loss_tokens)):
                s[i] += v
        assert all(a <= tokens and b <= segments and c <= loss for a, b, c in sums.values())
        assert sum(r.length for r in out) == sum(len(ids(t)) for t in texts.values())
        full = [sum(s[i] >= 0.95 * m for s in sums.values()) for i, m in enumerate((tokens, segments, loss))]
        assert full[2 if loss < tokens else 1] >= 5, full
        need = max(sum(s[i] for s in sums.values()) / m for i, m in enumerate((tokens, segments, loss)))
        assert len(sums) < 1.25 * need + 2
