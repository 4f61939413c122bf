import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyspring.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.FOLDER), reason="the vocabularies aren't here")
BPE = "byte_bpe_50k"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.FOLDER, f"{BPE}.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts():
    r = random.Random(0)
    words = ["It's", "don't", " they'll", "日本語", "を", "　", "naïve", "12345", "!?", "'s", "''s", "\n", "\n\n", "  ", "\t", "é", "🙂", "<|endoftext|>", "Привет", "a" * 50, "x_y", "--", "\r\n", " ", "​"]
    long = ["".join(r.choice(words) for _ in range(n)) for n in (3_000, 12_000)]
    return {
        1: None, 2: "", 3: " ", 4: "\n\n \n", 5: "<|endoftext|> is text", 6: "It's 2024, they'll say.", 7: "日本語のテキスト", 8: long[0], 9: long[1], 10: "a" * 40_000, 11: "'" * 20_000 + "s" * 20_000,
        12: "word " * 9_000, 13: "日本語、" * 12_000, 14: " " * 30_000 + "x", 15: "ab\n" * 9_000, 16: "It's 2024, they'll say.", 17: "\x00\x01", 18: "x" * tokens.CHUNK, 19: "x" * tokens.CHUNK + " y",
    }


def test_whole_table(spark, reference):
    given_ = texts()
    df = spark.createDataFrame(list(given_.items()), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS ids", "2 AS k", "3 AS chunk")
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df, "doc_id", "text", BPE).collect()}
    assert set(got) == set(given_)
    for k, t in given_.items():
        assert got[k] == (reference(t) if t else []), k
        assert tokens.decode(got[k], BPE) == (t or "")
    counted = {r.doc_id: r.tokens for r in tokens.encode_texts(df, "doc_id", "text", BPE, count=True).collect()}
    assert counted == {k: len(v) for k, v in got.items()}
    assert tokens.encode_texts(df.limit(0), "doc_id", "text", BPE).count() == 0


def test_long_texts_are_really_cut(spark):
    df = spark.createDataFrame([(1, "word " * 20_000), (2, "a" * 40_000)], "doc_id long, text string")
    pieces = {r.doc_id: r.n for r in tokens._pieces(df, "doc_id").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert pieces == {1: 7, 2: 1}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 \n'.sé日", min_size=1, max_size=80))
def test_boundaries_split_exactly(text):
    enc = tokens.byte_bpe(BPE, tokens.FOLDER).encode_ordinary
    whole = enc(text)
    for e in tokens.boundaries(text, 1, len(text), True):
        assert enc(text[:e]) + enc(text[e:]) == whole


PIECES = "piece_bpe_32k"


def test_sentence_pieces_of_long_texts(spark):
    model = tokens.piece_model(PIECES, tokens.FOLDER)
    assert tokens.parted_by_lines(PIECES, tokens.FOLDER)
    r = random.Random(3)
    words = ["def x():", "  return", "\n", "\n\n", "日本語", "\t", "  ", "🙂", "\r\n", " a", "é", "<0x0A>", "▁"]
    given_ = {1: None, 2: "", 3: "Hello world", 4: "word " * 5_000, 5: "".join(r.choice(words) for _ in range(30_000)), 6: "\n" * 50_000, 7: "x" * 20_000 + "\n" + "y" * 20_000, 8: "a\n" * 40_000, 9: " \n " * 20_000}
    df = spark.createDataFrame(list(given_.items()), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS piece", "2 AS ids")
    expected = {k: model.encode(t) if t else [] for k, t in given_.items()}
    assert {r.doc_id: r.ids for r in tokens.encode_texts(df, "doc_id", "text", PIECES).collect()} == expected
    assert {r.doc_id: r.tokens for r in tokens.encode_texts(df, "doc_id", "text", PIECES, count=True).collect()} == {k: len(v) for k, v in expected.items()}
    long = df.where("length(text) > 16384").select("doc_id", "text")
    pieces = long.mapInArrow(lambda it: tokens._line_pieces(it, "doc_id"), "doc_id long, piece long, text string").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in pieces if r.doc_id in (4, 6, 8)} == {4: 1, 6: 4, 8: 5}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 \t\r'.é日▁", max_size=30), st.text(alphabet="ab1 \n\t\r'.é日▁", max_size=30))
def test_line_breaks_part_sentence_pieces(before, after):
    model = tokens.piece_model(PIECES, tokens.FOLDER)
    whole = model.encode(before + "\n" + after)
    assert (model.encode(before) if before else whole[:1]) + tokens._after_start(model, "\n" + after) == whole
