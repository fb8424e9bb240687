"""Exact, line, passage and near duplicates against plain versions, on made-up rows full of repeats."""

import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from foliospark.llm import exact_dedup, line_dedup, simhash, substring_dedup
from foliospark.llm.components import components

ODD = [(None, None), (None, "a b"), (7, None), (8, ""), (9, "  \t\n "), (9, "  \t\n "), (3, "A b"), (3, "A b"), (3, "a B c")]
CLASHING = (
    "doc_id long, text string, lang string, doc_key string, text_key int, row string, n int, line int, "
    "keep string, kept string, copy int, root int, score double, n_chars long"
)


def widened(frame, rows):
    return frame([(d, t, None, "x", 1, "y", 2, 3, "z", "w", 4, 5, 0.5, len(t or "")) for d, t in rows], CLASHING)


def sentences(seed, n, words=12):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, words))) for _ in range(9)]
    glue = ["\n", " \n", "\n\n", " ", "\t", "\r\n"]
    rows = []
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.6 else rng.choice("XYZ") + str(rng.random()) for _ in range(rng.randint(0, 6))]
        text = "".join(p + rng.choice(glue) for p in parts)
        rows.append((rng.choice([i, i, i, i // 2, None]), text.upper() if rng.random() < 0.2 else text))
    return rows


@pytest.fixture(params=["one batch", "small batches"])
def batches(request, spark):
    if request.param == "small batches":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rows", [sentences(1, 60) + ODD, ODD, []], ids=["made-up", "odd", "none"])
@pytest.mark.parametrize("least", [2, 5])
def test_lines(frame, batches, rows, least):
    docs = widened(frame, rows)
    done = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=least))
    got = done.select("row.doc_id", "n_lines", "n_dropped", F.coalesce("kept", F.lit(""))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain.line_dedup(rows, least)))


def test_lines_keep_columns(frame):
    rows = [(i, f"same line\nown {i}") for i in range(12)] + [(20, None)]
    done = line_dedup.drop_frequent_lines(widened(frame, rows))
    assert done.columns == widened(frame, rows).columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in done.collect()}
    assert got[3] == ("own 3", 5) and got[20] == (None, 0)


def test_frequent_line_over_many_partitions(spark, frame):
    rows = [(i, "hot\n" * (i % 3) + "hot") for i in range(400)] + [(1000 + i, f"cold {i // 9}") for i in range(36)]
    docs = frame(rows).repartition(13)
    got = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs)).select("row.doc_id", "n_dropped").collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {d: t.count("hot") for d, t in rows}


def test_long_bitmap():
    lines = [f"{i}" for i in range(1000)]
    import pyarrow as pa

    dropped = [[999], [0, 8, 16], list(range(500))]
    packed = line_dedup.bitmap.func(pa.array(dropped, pa.list_(pa.int32()))).to_pylist()
    for gone, bits in zip(dropped, packed):
        assert line_dedup.kept_lines("\n".join(lines), bits) == "\n".join(x for i, x in enumerate(lines) if i not in set(gone))
    assert len(packed[2]) < 60


@pytest.mark.parametrize("width", [3, 12])
@pytest.mark.parametrize("rows", [sentences(2, 80) + ODD, ODD, []], ids=["made-up", "odd", "none"])
def test_passages(frame, batches, rows, width):
    docs = frame(rows)
    done = substring_dedup.without_repeats(docs, substring_dedup.repeated_intervals(docs, width=width))
    got = done.select("row.doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain.substring_dedup(rows, width)))


def test_passage_of_one_word_and_at_all_places(frame):
    rng = random.Random(5)
    shared = [str(rng.random()) for _ in range(35)]
    rows = [(1, "the " * 200), (2, " ".join(shared)), (3, "x " * 3 + " ".join(shared) + "\ny")]
    rows += [(4, " ".join(shared[1:])), (5, " ".join(str(rng.random()) for _ in range(40000)))]
    docs = frame(rows)
    done = substring_dedup.without_repeats(docs, substring_dedup.repeated_intervals(docs))
    got = done.select("row.doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(plain.substring_dedup(rows, 35))


def test_pieces_do_not_change_passages(frame, monkeypatch):
    rows = sentences(3, 60)
    import pyarrow as pa

    from foliospark.llm import words

    texts = pa.array([t for _, t in rows])
    whole = next(words.pieces(texts))
    found = substring_dedup.Windows(whole[2], whole[3], 5).hashes
    parts = [substring_dedup.Windows(p[2], p[3], 5).hashes for p in words.pieces(texts, 10)]
    assert np.array_equal(found, np.concatenate(parts)) and len(parts) > 20


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("rows", [sentences(4, 50) + ODD, ODD, [], [(i, "Hot") for i in range(300)]])
def test_exact(frame, rows, keep):
    got = exact_dedup.exact_groups(widened(frame, rows), keep=keep, slices=4).collect()
    groups = {}
    for doc, text in rows:
        groups.setdefault(plain.lower(text or ""), []).append(doc)
    want = []
    for text, ids in groups.items():
        known = [d for d in ids if d is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        kept = False
        for doc in ids:
            want.append((doc, best, len(ids), doc == best and not kept, plain.sha(text)))
            kept |= doc == best
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("rows", [sentences(6, 70, 3) + ODD, ODD, []], ids=["made-up", "odd", "none"])
def test_near(frame, rows):
    found = simhash.near_groups(widened(frame, rows)).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0"), "component_id"
    )
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain.near_groups(rows)))


def test_one_of_each_group(frame):
    rows = sentences(6, 70, 3) + ODD
    docs = widened(frame, rows)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    groups = plain.near_groups([(i, t) for i, (_, t) in enumerate(rows)])
    got = [r["doc_id"] for r in kept.collect()]
    of = {}
    for (doc, _), (_, _, group) in zip(rows, groups):
        of.setdefault(group, []).append(doc)
    want = [min((d for d in ids if d is not None), default=None) for ids in of.values()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("front", [simhash.FRONTIER, 7])
def test_trie(monkeypatch, front):
    monkeypatch.setattr(simhash, "FRONTIER", front)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)

    def values(n):
        near = centres[rng.integers(0, 20, n)]
        for _ in range(3):
            near = near ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        return np.unique(np.concatenate([near, rng.integers(0, 2**63, n // 2, dtype=np.uint64)]))

    a = values(150)
    b = np.setdiff1d(values(150), a)
    for left, right, same in ((a, b, False), (a, a, True)):
        near = np.bitwise_count(left[:, None] ^ right[None, :]) <= 3
        want = set(zip(*np.nonzero(np.triu(near, 1) if same else near)))
        got = [pair for i, j in simhash.near_pairs(left, right, 3, same) for pair in zip(i, j)]
        assert set(got) == want and len(got) == len(want)


def test_trie_blocks(spark, frame):
    rows = [(i, "w " * (i % 5 + 1) + f"tail{i}") for i in range(120)]
    prints = [(plain.fingerprint(t) ^ 0) for _, t in rows]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    table = spark.createDataFrame([(p,) for p in signed], "print long")
    edges = simhash.linked(table, len(signed), block=4)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    for p in signed:
        for q in signed:
            if ((p ^ q) & (2**64 - 1)).bit_count() <= 3 and p != q:
                assert roots[p] == roots[q]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(i, 100) for i in range(101, 180)]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 180)}
    assert {r["node"]: r["root"] for r in found} == want and len(found) == len(want)
