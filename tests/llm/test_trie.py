import random

import plain_trie

from foliospark.llm import conversation_trie as CT

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, block=CT.BLOCK):
    got = CT.trie(spark.createDataFrame(rows, SCHEMA), block).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[1], r[0]))


def test_edge_cases_equal_plain(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, None, "system", "first"),
        (1, 0, "user", "hi"), (1, 1, None, None), (1, 1, None, None),  # repeated rows: two turns
        (2, 5, "user", "x"), (2, 5, "user", "a"),  # tie on turn: ordered by role, text
        (3, 0, "user", "only"),
        (5, 0, "user", "hi"), (6, 0, "user", "héllo wörld"), (9, 0, None, "z"),
        (-3, 0, "user", "neg"), (-7, 2, "user", "neg2"),
        (None, 0, "user", "nobody"),
        (12, 0, "user", "t"),  # base 10 absent
    ]
    assert run(spark, rows) == plain_trie.trie(rows)


def test_random_trees_all_blocks(spark):
    rnd = random.Random(5)
    rows = []
    for conv in range(0, 60):
        n = rnd.choice([0, 1, 3, 4, 5, 8, 9, 13])
        for t in range(n):
            rows.append((conv, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "c"]) if t > 2 else "same"))
    expected = plain_trie.trie(rows)
    for block in (1, 2, 4, 5):
        assert run(spark, rows, block) == expected


def test_long_shared_prefix_and_copies(spark):
    stem = [("user", f"turn {i}") for i in range(30)]
    rows = []
    for conv in range(20):
        for t, (role, text) in enumerate(stem[: 10 + conv]):
            rows.append((conv * 5, t, role, text))
        rows.append((conv * 5, 99, "user", "tail" if conv % 2 else "other"))
    rows += [(200 + c, t, "user", "copy") for c in range(30) for t in range(6)]
    assert run(spark, rows) == plain_trie.trie(rows)


def test_empty_and_clashing(spark):
    assert CT.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "x", 7, 8)], SCHEMA + ", depth long, n_convs long")
    got = sorted(tuple(r) for r in CT.trie(clash).collect())
    assert [r[1] for r in got] == [0, 1] or [r[1] for r in got] == [0]
