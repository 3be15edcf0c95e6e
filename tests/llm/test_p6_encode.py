import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import encode as en

PATH = f"{en.VOCABULARIES}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcé漢 \n1-'s", max_size=400), st.sampled_from([4, 16, 64]), st.sampled_from([20, 100]))
def test_tree_concatenation_equals_plain_encoding(text, limit, chunk):
    codec = en.codec(PATH)
    parts = [(k, p, codec.segment(b) if p >= 0 else codec.plain(b.decode())) for k, p, b in en.split(text, chunk, limit)]
    ids = []
    for _, part, codes in en.sorted_parts(reversed(parts)):
        ids += codec.tree(codes) if part >= 0 else codes[0]
    assert ids == codec.plain(text)
    assert b"".join(codec.bytes_of[i] for i in ids).decode() == text


def test_table(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "  \n ", "Hello world", "<|endoftext|>", "a" * 30_000, "ab" * 9_000 + " " * 5_000, "mixed Ünïcode 漢字 🎉 " * 900, "x y"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(3, "Hello world", 7)], "doc_id bigint, text string, ids int")
    found = {r.doc_id: r.ids for r in en.encoded(df).collect()}
    t = Tokenizer.from_file(f"{en.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    assert found == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert en.encoded(df).count() == len(texts) + 1
    assert en.encoded(df.limit(0)).count() == 0


def in_chunks(codec, text, chunk=en.CHUNK_CHARS, limit=en.SEGMENT_BYTES):
    ids = []
    for _, part, codes in en.sorted_parts((k, p, codec.segment(b) if p >= 0 else codec.plain(b.decode())) for k, p, b in en.split(text, chunk, limit)):
        ids += codec.tree(codes) if part >= 0 else codes[0]
    return ids


@pytest.mark.parametrize("blanks", ["\n\n", "\n\n\n", "\t\t", " \n", "\n ", "  ", "\u3000\u3000", "\n", "\x1c\x1d", "\n\x1c"])
def test_blanks_at_every_border(blanks):
    codec = en.codec(PATH)
    text = "".join(f"{'ab' * (k % 5 + 1)}.{blanks}" for k in range(60)) + "end"
    for chunk in range(1, 80):
        assert in_chunks(codec, text, chunk) == codec.plain(text)
    for tail in ("w" * 3_000, "." * 3_000, "7" * 3_000):  # an unsplit part after blanks, and blanks after it
        text = f"some words{blanks}{tail}{blanks}and more{blanks}"
        for chunk in (1, 8, 5_000):
            assert in_chunks(codec, text, chunk) == codec.plain(text)
        assert codec.encode(text) == codec.plain(text)


def test_blank_line_at_the_border_of_a_long_text(spark):
    texts = ["ab " * 2_728 + ".\n\n" + "wordlong and more text " * 50, "x.\n\n" + "a" * 9_000, "x.\n\n" + "a" * 3_000]
    found = {r.doc_id: r.ids for r in en.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert found == dict(enumerate(map(en.codec(PATH).plain, texts)))


def test_long_rows_of_one_id_stay_apart(spark):
    one, two = "word " * 4_000, "other words " * 3_000
    rows = [(1, one), (1, one), (1, two), (None, one), (None, two), (2, "short"), (2, "short")]
    plain = en.codec(PATH).plain
    found = sorted(((r.doc_id, r.ids) for r in en.encoded(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert found == sorted(((i, plain(t)) for i, t in rows), key=repr)
