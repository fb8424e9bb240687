"""Token counts of whole texts, chunk by chunk, as a byte-level BPE tokenizer gives them.

The tokenizer is a transducer from characters to tokens that reads its input in two layers: a
pre-tokeniser (a finite automaton over character classes) cuts the text into pieces, and the merges
run inside each piece only.  The count of a text is therefore the sum over pieces, and any cut that the
pre-tokeniser itself makes is a point where its automaton is in the same state whatever came before.

For the pattern of the byte-level vocabularies (see ``public_tokenizers.PATTERN``) such a synchronising
word is a space (U+0020) followed by an ASCII letter: no alternative of the pattern runs over a space
into a letter except `` ?\\p{L}+``, which starts at that space, and the whitespace alternatives give the
space up because ``(?!\\S)`` fails before the letter.  The special string ``<|endoftext|>`` holds no
space, so the split of added tokens never crosses such a cut either.

1. In the JVM, each text is cut into chunks of at least ``CHUNK`` characters, each ending right before
   the next synchronising word (or at the end).  The cut needs no Python and no shuffle.
2. Every chunk therefore starts in the reset state, so its state map is constant: the count of its
   tokens.  The maps of a text compose by addition, which is the whole prefix scan here.
3. Chunk counts come from the tokenizer library itself (exact merges, added tokens as its default),
   in Arrow batches; the vocabulary travels as a broadcast string, so executors need no local file.

Not done: compiling the 50k merges into one deterministic transducer over bytes.  Its state count
grows with the merge table far beyond memory; counting chunks with the library gives the same numbers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest characters of a chunk before it ends at the next synchronising word.
CHUNK = 4096
#: Token count above which a text is over the limit.
LIMIT = 512
#: Characters handed to the tokenizer at once; its encodings take about 60 bytes a character.
BATCH_CHARS = 1 << 20
#: Vocabulary of the count.
VOCABULARY = "byte_bpe_50k.json"


def chunks(text: Column, least: int = CHUNK) -> Column:
    """Pieces of ``text`` (null: none) cut right before a space that precedes an ASCII letter.

    Each piece but the last holds ``least`` characters or more; joined they give the text back.
    """
    pattern = f"(?s)(?:.{{{least}}}.*?(?= [A-Za-z])|.+)"
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(text, F.lit(pattern), 0)
    )


def _vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
            limit: int = LIMIT, least: int = CHUNK) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens), ``n_chunks``.

    One row per input row, repeated rows and null ids included.  A null text counts as empty: zero bytes,
    zero tokens.  No begin or end token is added; special strings inside a text count as the library's
    default has them (``<|endoftext|>`` is one token).  Nothing is truncated.  Extra input columns are not
    carried.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(_vocabulary_path(vocabulary), encoding="utf-8") as handle:
        shared = spark.sparkContext.broadcast(handle.read())  # one vocabulary file: a fixed size

    @F.pandas_udf("long")
    def tokens(pieces: pd.Series) -> pd.Series:
        tokenizer = _tokenizer(shared, vocabulary)
        out = []
        batch, owners, held = [], [], 0

        def flush():
            # the encodings of one bounded batch live only as long as their counts are taken
            for owner, encoding in zip(owners, tokenizer.encode_batch(batch, add_special_tokens=False)):
                out[owner] += len(encoding.ids)
            batch.clear(), owners.clear()

        for row in pieces:
            out.append(0)
            for piece in row:
                batch.append(piece)
                owners.append(len(out) - 1)
                held += len(piece)
                if held >= BATCH_CHARS:
                    flush()
                    held = 0
        if batch:
            flush()
        return pd.Series(out, dtype="int64")

    text = F.col(text_col)
    pieces = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        chunks(F.col("text"), least).alias("pieces"),
    )
    return pieces.select(
        "doc_id", "n_bytes", tokens("pieces").alias("n_tokens"), F.size("pieces").cast("long").alias("n_chunks")
    ).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")


_LOADED: dict = {}


def _tokenizer(shared, key: str):
    """One tokenizer per Python worker and vocabulary, built from the broadcast file.

    Its thread pool is held to one thread: Spark already runs one task a core.
    """
    import os

    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer.from_str(shared.value)
    return _LOADED[key]
