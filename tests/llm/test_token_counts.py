import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import token_counts as TC

TEXTS = [
    None,
    "",
    "Hello world",
    "a  b   c\n\n d\t e",
    "it' s <|endoftext|> done<|endoftext|>x",
    "日本語のテキスト" * 300,
    ("word " * 3000) + "tail",
    "Über straße naïve café " * 500,
    "12345 " * 2000 + "   \n  end",
    "x" * 20000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(TC.VOCABULARY))


def test_counts_equal_the_whole_text(spark, tokenizer):
    rows = [(i, text) for i, text in enumerate(TEXTS)] + [(2, "Hello world"), (None, "again")]
    got = TC.counted(spark.createDataFrame(rows, "doc_id long, text string"), least=64).collect()
    assert len(got) == len(rows)
    expected = sorted(
        (i if i is not None else -1, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows
    )
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got) == expected
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].n_tokens == 0 and by_id[0].n_bytes == 0 and by_id[1].n_chunks == 0
    assert by_id[6].n_chunks > 10  # long texts are counted in pieces
    assert by_id[9].n_chunks == 1  # no cut point: one piece
    assert by_id[5].n_bytes == len(TEXTS[5].encode())
    assert by_id[6].over_limit and not by_id[2].over_limit


def test_chunks_join_back(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS if t], "text string")
    for row in frame.select("text", TC.chunks(F.col("text"), 16).alias("c")).collect():
        assert "".join(row.c) == row.text
        assert all(len(piece) >= 16 for piece in row.c[:-1])


def test_empty_and_clashing(spark):
    assert TC.counted(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, "some text", 5)], "doc_id long, text string, n_tokens int")
    assert TC.counted(clash).first().n_tokens == 2
