"""Encoding and splitting: exact round trips against whole-text encoding, limits and odd texts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shalework.llm import queries, splitting, tokens

public = pytest.importorskip("public_tokenizers")
ENC = tokens.encoder()

ODD = ["", " ", "\n\n\n", "'", "''''ll're 's", "a" * 5000, " " * 3000, "日本語" * 900, "x'll " * 500, "é́" * 700, "🎉👩\u200d👩\u200d👧" * 300, "<|endoftext|> a", "\x00\x07�\u200b\ufeff", "a1b2c3" * 600, "\r\n\t \r" * 400, "ß¶…" * 300]
PIECES = st.sampled_from(["a", "'", "'s", "'ll", " ", "  ", "\n", "1", "23", "。", "、", "語", "ア", "é", "!", "--", "🎉", "\u00a0", "ſ", "Ⅷ", "́", "x" * 30])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join), st.integers(1, 9))
def test_tree_equals_whole(text, leaf):
    assert list(ENC.encode(text, leaf=leaf)) == ENC.plain(text)


@pytest.mark.parametrize("text", ODD)
def test_tree_of_odd_texts(text):
    for leaf in (3, 50, 1000):
        assert list(ENC.encode(text, leaf=leaf)) == ENC.plain(text)


def test_other_library_agrees():
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for text in ODD:
        assert tokenizer.encode(text, add_special_tokens=False).ids == list(ENC.encode(text))


def test_documents_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (100, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = tokens.encode_documents(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = [(r.doc_id, r.ids) for r in out.collect()]
    assert got.count((100, [])) == 2 and (0, []) in got and len(got) == len(rows)
    back = {r.doc_id: r.text for r in tokens.decode_documents(out).collect()}
    assert all(back[i] == t for i, t in enumerate(ODD))


def test_documents_of_an_empty_table(spark):
    assert tokens.encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_p8_covers_every_document(spark, sf):
    from shalework.session import table

    assert queries.p8_ids(spark, sf).count() == table(spark, sf, "documents").count()


def check_pieces(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for k, (a, z, n, shared, _) in enumerate(pieces):
        assert a < z and len(ENC.plain(text[a:z])) == n <= limit
        if k:
            before = pieces[k - 1]
            assert before[0] < a <= before[1] < z
            assert len(ENC.plain(text[a : before[1]])) == shared <= overlap


@pytest.mark.parametrize("limit,overlap", [(512, 64), (16, 4), (5, 0), (9, 8)])
@pytest.mark.parametrize("text", [*ODD, "One two. Three; four, five.\n\nSix seven\n" * 90, "   1   Set Field [ A::b ; 1 ]\n" * 200])
def test_pieces(text, limit, overlap):
    ids = np.asarray(ENC.encode(text))
    if len(ids) > limit:
        check_pieces(text, splitting.split(text, ids, ENC, limit, overlap), limit, overlap)


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, min_size=20, max_size=200).map("".join))
def test_pieces_of_any_text(text):
    ids = np.asarray(ENC.encode(text))
    if len(ids) > 12:
        check_pieces(text, splitting.split(text, ids, ENC, 12, 3), 12, 3)


@pytest.mark.parametrize("stretch", ["\t" * 5000, "a" * 9000, " " * 40000, "x" * 1500, "x" * 4000])
@pytest.mark.parametrize("head,tail", [(0, 400), (400, 0), (400, 400), (3, 400)])
def test_only_the_stretch_without_a_cut_is_forced(stretch, head, tail):
    line = "Alpha beta gamma, delta. Epsilon zeta.\n"
    text = line * head + stretch + "\n" + line * tail
    ids = np.asarray(ENC.encode(text))
    pieces = splitting.split(text, ids, ENC)
    check_pieces(text, pieces, splitting.LIMIT, splitting.OVERLAP)
    a, z = len(line) * head, len(line) * head + len(stretch) + 1
    for before, piece in zip(pieces, pieces[1:]):
        if piece[1] <= a or before[0] >= z:  # both in the ordinary text
            assert 0 < piece[3] <= splitting.OVERLAP


def test_many_short_runs_keep_the_overlap():
    rnd = random.Random(3)
    text = "".join("".join(rnd.choice("word line item\n".split(" ")) + " " for _ in range(rnd.randint(1, 90))) + "\t" * rnd.choice([1, 200, 330, 410]) + "\n" for _ in range(60))
    for limit, overlap in ((512, 64), (430, 60)):
        ids = np.asarray(ENC.encode(text))
        pieces = splitting.split(text, ids, ENC, limit, overlap)
        check_pieces(text, pieces, limit, overlap)
        assert sum(p[3] > 0 for p in pieces) > len(pieces) // 3


def test_paragraphs_win_over_lines():
    text = ("word " * 60 + "\n" + "word " * 60 + "\n\n") * 6
    pieces = splitting.split(text, np.asarray(ENC.encode(text)), ENC, 160, 20)
    assert {splitting.STRENGTHS[p[4]] for p in pieces[:-1]} <= {"paragraph", "line"}


def test_split_documents(spark):
    long = "Alpha beta gamma. " * 400
    rows = [(1, long), (1, long), (2, None), (3, ""), (4, "short"), (5, "a" * 20000), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece_no", F.lit("clash")).withColumn("pieces", F.lit(1))
    got = splitting.split_documents(df).collect()
    assert {r.doc_id for r in got} == {1, 5, None}
    assert all(r.text == (long if r.doc_id != 5 else "a" * 20000)[r.char_start : r.char_end] for r in got)
    assert sum(r.piece_no == 1 for r in got if r.doc_id == 1) == 2
    assert splitting.split_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        splitting.split_documents(df, limit=10, overlap=10)
