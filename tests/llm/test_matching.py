"""Leaked benchmark items, licences, packing."""

import itertools
import random

import plain
import pytest
from pyspark.sql import functions as F

from foliospark.llm import decontamination, licenses, packing


def made_up(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 14)))) for i in range(8)]
    docs = []
    for i in range(40):
        parts = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 9))]
        if rng.random() < 0.7:
            words = rng.choice(items)[1].split()
            cut = rng.randint(0, len(words))
            parts += words[cut:] + [","] * rng.randint(0, 1) + words[:cut]
        docs.append((i, " ".join(parts).upper() if rng.random() < 0.3 else ", ".join(parts)))
    return items, docs


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
@pytest.mark.parametrize("least", [2, 4])
def test_leaks(frame, least, block_bytes):
    items, docs = made_up(least)
    docs += [(None, items[3][1]), (50, None), (51, ""), (52, items[3][1]), (52, items[3][1])]
    bench = frame(items + [(None, None), (90, ""), items[2]], "item_id long, text string")
    table = frame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, item_id int, tiles int")
    found = decontamination.leaks(table, bench, min_match=least, threshold=0.6, block_bytes=block_bytes)
    got = [(r["doc_id"], r["item_id"], r["n_covered"], r["n_tokens"]) for r in found.collect()]
    want = []
    for doc, text in docs:
        for item, content in items:
            covered, size = plain.tiling(text or "", content, least)
            if size and covered >= 0.6 * size:
                want.append((doc, item, covered, size))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 10
    clean = decontamination.without_leaks(table, bench, min_match=least, threshold=0.6, block_bytes=block_bytes)
    assert clean.columns == table.columns
    leaking = {w[0] for w in want}
    assert sorted(map(repr, (r["doc_id"] for r in clean.collect()))) == sorted(repr(d) for d, _ in docs if d not in leaking)


def test_leaks_of_nothing(frame):
    empty = frame([], "item_id long, text string")
    docs = frame([(1, "a b c")])
    assert decontamination.leaks(docs, empty).count() == 0
    assert decontamination.without_leaks(docs, empty).count() == 1
    assert decontamination.leaks(frame([]), frame([(1, "a b")], "item_id long, text string")).count() == 0


def test_moved_passage_in_a_long_text(frame):
    rng = random.Random(3)
    item = [f"w{rng.randint(0, 10**9)}" for _ in range(40)]
    noise = [f"n{rng.randint(0, 999)}" for _ in range(60_000)]
    text = " ".join(noise[:30_000] + item[20:] + noise[30_000:] + item[:20])
    half = " ".join(noise[:50] + item[:15])
    docs = frame([(1, text), (2, half), (3, " ".join(noise))])
    found = decontamination.leaks(docs, frame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["coverage"], len(r["tiles"])) for r in found] == [(1, 1.0, 2)]


def test_licenses(spark, frame):
    mit = dict((k, v) for k, v in licenses.KNOWN if v.startswith("MIT License"))["MIT"]
    isc = next(v for k, v in licenses.KNOWN if k == "ISC")
    rows = [
        (1, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(", ", ",\n   ")),
        (2, "(C) nobody\n" + mit),
        (3, isc.replace("DISCLAIMS", "disclaims").replace(",", " ;")),
        (4, "text\nReleased under the MIT Licence\n  licensed under CC BY-NC 4.0\nend"),
        (5, None), (6, ""), (None, "SPDX-License-Identifier: MIT"), (7, mit + " more"), (4, "x"), (4, "x"),
    ]
    docs = frame([(d, t, "a", 1) for d, t in rows], "doc_id long, text string, digest string, row int")
    got = licenses.scanned(docs, licenses.known_digests(spark)).collect()
    found = sorted((r["doc_id"] or 0, r["license_id"] or "", r["line_licenses"] or "") for r in got)
    assert found == sorted(
        [(1, "MIT", ""), (2, "", "MIT"), (3, "ISC", "ISC"), (4, "", "CC-BY-NC-4.0,MIT"), (5, "", ""), (6, "", ""),
         (0, "MIT", "MIT"), (7, "", ""), (4, "", ""), (4, "", "")]
    )
    assert licenses.scanned(frame([]), licenses.known_digests(spark)).count() == 0
    assert licenses.scanned(docs, licenses.known_digests(spark, [])).where("license_id is not null").count() == 0


def test_too_many_known_licenses(spark, frame, monkeypatch):
    monkeypatch.setattr(licenses, "MAX_KNOWN", 2)
    with pytest.raises(ValueError, match="at most 2"):
        licenses.scanned(frame([(1, "a")]), licenses.known_digests(spark))


def padded(histogram, bounds):
    return sum(n * min(b for b in bounds if b >= length) for length, n in histogram)


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(300):
        size, buckets = rng.randint(1, 9), rng.randint(1, 10)
        lengths = sorted(rng.sample(range(40), size))
        histogram = [(length, rng.randint(1, 9)) for length in lengths]
        bounds = packing.best_boundaries(histogram, buckets)
        tries = (
            [*inner, lengths[-1]]
            for k in range(min(buckets, size))
            for inner in itertools.combinations(lengths[:-1], k)
        )
        assert len(bounds) <= buckets
        assert padded(histogram, bounds) == min(padded(histogram, t) for t in tries)
    assert packing.best_boundaries([], 4) == []


@pytest.mark.parametrize("slice_rows", [50_000, 7])
def test_packing(frame, slice_rows):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 30)) for i in range(200)]
    rows += [(None, None), (None, "a"), (5, "b"), (5, "b"), (900, "w " * 500), (901, "")]
    table = frame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n_tokens int, bucket int")
    found = packing.packed(table, buckets=4, budget=60, slice_rows=slice_rows).toPandas()
    assert len(found) == len(rows)
    assert sorted(found.n_tokens) == sorted(len((t or "").split()) for _, t in rows)
    assert (found.padding == found.bucket_len - found.n_tokens).all() and (found.padding >= 0).all()
    lengths = found.groupby("n_tokens").size()
    assert found.bucket_len.sum() == padded(lengths.items(), packing.best_boundaries(list(lengths.items()), 4))
    for bucket_len, part in found.groupby("bucket_len"):
        room = max(1, 60 // max(1, bucket_len))
        place = sorted(part.batch * room + part.slot)
        assert place == list(range(len(part))) and part.slot.max() < room
    again = packing.packed(table.repartition(5), buckets=4, budget=60, slice_rows=slice_rows).toPandas()
    key = [c for c in found.columns]
    assert sorted(map(repr, found[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))


def test_packing_nothing(frame):
    assert packing.packed(frame([])).count() == 0


def test_grid(spark):
    lengths = [1, 65_536, 65_537, 131_072, 131_073, 10**7 + 3, 0]
    table = spark.createDataFrame([(n,) for n in lengths], "n long")
    for row in table.select("n", packing.grid(F.col("n")).alias("g")).collect():
        assert row["g"] >= row["n"] and row["g"] - row["n"] <= row["n"] / 4096
        assert row["n"] > 65_536 or row["g"] == row["n"]
