import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symweave.llm import packing, tokens

TEXTS = [
    None, "", " ", "\n\n", "Hello world, it's 3 o'clock!", "<|endoftext|> stays text", "a b  c\r\n\td  ", "naïve 日本語テスト 🚀🇪🇺 ﬁ ½³",
    "é x​x ᠎  \x1c\x85 'sx ''s don'T", "x" * 3000, "word " * 2000, "\U0001fae8 \U0001f6dc ౝ ᲊ", "    indent\n\n\n  more",
]
SCHEMA = "doc_id long, text string, words string, ids string, sizes int, key string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "w", "i", 1, "k") for i, t in enumerate(texts)], SCHEMA)


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("most", [tokens.HEAD_WORDS, 3])
def test_same_ids_as_the_library_and_back(spark, most):
    encoded = tokens.encode_corpus(documents(spark, TEXTS + TEXTS), head=most)
    assert [list(r.ids) for r in encoded.orderBy("doc_id").collect()] == library(TEXTS + TEXTS)
    texts = tokens.decode_corpus(encoded, tokens.piece_table(spark)).orderBy("doc_id").collect()
    assert [r.text for r in texts] == [t or "" for t in TEXTS + TEXTS]


def test_repeated_rows_and_ids(spark):
    twice = spark.createDataFrame([(1, "a rare word"), (1, "a rare word"), (1, "another rarer text"), (2, None)], "doc_id long, text string")
    for most in (tokens.HEAD_WORDS, 2):
        got = sorted(list(r.ids) for r in tokens.encode_corpus(twice, head=most).collect())
        assert got == sorted(library(["a rare word"] * 2 + ["another rarer text", None]))


def test_empty_table_and_unknown_ids(spark):
    assert tokens.encode_corpus(documents(spark, [])).collect() == []
    odd = spark.createDataFrame([(1, [60000]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode_corpus(odd, tokens.piece_table(spark)).collect()} == {1: None, 2: None, 3: ""}


def packs_of(spark, texts, budgets):
    b = spark.createDataFrame(budgets, "budget_id long, name string, tokenizer string, capacity_tokens int")
    return packing.pack_corpus(documents(spark, texts), b), b


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_packs_hold_every_text(spark, name):
    texts = TEXTS + [f"text number {i} " * (i % 40) for i in range(300)]
    packs, budgets = packs_of(spark, texts, [(1, "s", name, 64), (2, "m", name, 700), (3, "none", name, 0)])
    rows = packs.collect()
    sizes = [len(ids) for ids in tokens.encoder(name)([t or "" for t in texts])]
    for budget, capacity in ((1, 64), (2, 700)):
        own = [r for r in rows if r.budget_id == budget]
        used = {}
        for r in own:
            used[r.pack_id] = used.get(r.pack_id, 0) + r.end_token - r.start_token
        assert max(used.values()) <= capacity
        for doc, size in enumerate(sizes):
            pieces = sorted((r.start_token, r.end_token) for r in own if r.doc_id == doc)
            assert pieces[0][0] == 0 and pieces[-1][1] == size and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
            assert len(pieces) == max(1, -(-size // capacity))
        assert len(used) <= -(-sum(sizes) // capacity) * 1.05 + 2
    report = {r.budget_id: r for r in packing.fill_report(packs, budgets).collect()}
    assert report[1].n_tokens == sum(sizes) and report[1].fullest <= 64 and 3 not in report


def test_packs_of_nothing(spark):
    assert packs_of(spark, [], [(1, "s", "byte_bpe_50k", 64)])[0].collect() == []
    assert packs_of(spark, TEXTS, [])[0].collect() == []


def test_curve_visits_neighbours():
    import numpy as np

    for bits in (2, 3):
        grid = np.array([(x, y, z) for x in range(1 << bits) for y in range(1 << bits) for z in range(1 << bits)])
        order = grid[np.argsort(packing.hilbert_key(grid, bits))]
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=60))
def test_words_of_the_library_encode_alone(text):
    import regex

    encode = tokens.encoder("byte_bpe_50k")
    pieces = regex.findall(tokens.PATTERN, text)
    assert "".join(pieces) == text and [i for ids in encode(pieces) for i in ids] == encode([text])[0]
