"""Near copies by exact shingle overlap, against all pairs."""

import random
from collections import defaultdict

import pytest
from plain import WORD, lower

import corpus_pipeline
from foliospark.llm import jaccard, simhash

ODD = [(None, None), (None, "a b"), (901, ""), (902, " \n"), (903, "A b"), (904, "a b c"), (904, "a b c"), (905, None)]


def shingles(text):
    words = WORD.findall(lower(text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def kept_ids(rows, least=0.8):
    """The smallest id of each component of all pairs."""
    sets = [shingles(text) for _, text in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                group[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[root(i)].append(doc)
    return sorted(map(repr, (min((d for d in of if d is not None), default=None) for of in ids.values())))


def edited(seed, groups, copies):
    """Texts and copies with some words in a row replaced: similarities on both sides of 0.8, and chains."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(copies):
            rows.append((len(rows), " ".join(words)))
            n = rng.randint(0, len(words) // 7)
            at = rng.randint(0, len(words) - n)
            words = [*words[:at], *[f"n{rng.randint(0, 10**6)}" for _ in range(n)], *words[at + n :]]
    return rows


@pytest.mark.parametrize("rows", [edited(1, 12, 9) + ODD, ODD, []], ids=["edited", "odd", "empty"])
def test_groups_are_those_of_all_pairs(frame, rows):
    kept = simhash.one_of_each_group(frame(rows), grouping=jaccard.near_groups)
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == kept_ids(rows)


def test_jaccard_drops_what_three_bits_miss(spark, frame):
    """A copy at 0.9 whose fingerprint differs in more than three bits: the Jaccard grouping drops it, while the
    pipeline's near-dedup stage, which follows the SimHash contract (3-word shingles, 3 bits), keeps it."""
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    copies = ([*words[:at], "other", "words", *words[at + 2 :]] for at in range(20, 180, 3))
    first = " ".join(words)
    text = next(
        t for t in map(" ".join, copies)
        if (simhash.fingerprint(first.encode()) ^ simhash.fingerprint(t.encode())).bit_count() > 3
    )
    a, b = shingles(first), shingles(text)
    assert len(a & b) > 0.9 * len(a | b)
    docs = frame([(1, first), (2, text), (3, "something else")])
    by_jaccard = simhash.one_of_each_group(docs, grouping=jaccard.near_groups)
    assert sorted(r["doc_id"] for r in by_jaccard.collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 2, 3]


def test_pairs_of_a_bucket_that_its_first_print_does_not_link(spark):
    """Two groups and single sets in one bucket: found in later rounds, none linked to another."""
    rng = random.Random(6)
    centres = [rng.sample(range(10**6), 50) for _ in range(6)]
    sets = [sorted([*c[:48], n, n + 1]) for c in centres[:2] for n in range(2_000_000, 2_000_020, 2)] + [sorted(c) for c in centres[2:]]
    prints = rng.sample(range(1000), len(sets))
    packed = [(p, b"".join(x.to_bytes(8, "little") for x in s)) for p, s in zip(prints, sets)]
    shared = spark.createDataFrame([(7, p, 50) for p in prints], "bucket long, print long, size int")
    edges = jaccard.linked(shared, spark.createDataFrame(packed, "print long, packed binary")).collect()
    side = {p: i // 10 if i < 20 else i for i, p in enumerate(prints)}
    assert all(side[e["u"]] == side[e["v"]] and e["u"] > e["v"] for e in edges)
    assert len({e["u"] for e in edges}) == 18
