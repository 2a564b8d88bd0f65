"""Near-duplicates and repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolk.llm import neardup, substrings
from tests.llm.helpers import ODD, WORD, documents, edited, folder, prose
from tests.oracle import assert_same

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    label = [i for i, _ in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return [(i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, label)]


def near_rows():
    rows = list(ODD)
    base = [prose(s, 150) for s in range(6)]
    n = 0
    for s, text in enumerate(base):
        for e in range(8):
            rows.append((n, edited(text, 10 * s + e, e * 0.006)))
            n += 1
        rows.append((n, text.upper()))
        n += 1
    chain = prose(99, 300)
    for step in range(12):  # each near the one before, the ends far apart
        rows.append((n, chain))
        chain = edited(chain, 500 + step, 0.015)
        n += 1
    rows += [(n + i, base[0]) for i in range(30)]
    return rows


@pytest.mark.parametrize("rounds", [0, 2])
@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(neardup, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_rows()
    d = documents(spark, rows).withColumn("band", F.lit(1)).withColumn("id", F.lit(2))
    got = sorted(tuple(r) for r in neardup.near_duplicates(d, 4, 80).collect())
    assert got == sorted(brute_components(rows, 4, 80))


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(documents(spark, []), 4, 80).count() == 0
    got = neardup.near_duplicates(documents(spark, [(1, None), (2, None), (3, "")]), 4, 80)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_rows_without_an_id(spark):
    rows = [(5, prose(1, 30)), (None, prose(1, 30)), (None, prose(2, 30)), (None, prose(2, 30)), (None, None), (6, prose(1, 30))]
    got = [tuple(r) for r in neardup.near_duplicates(documents(spark, rows), 4, 80).collect()]
    assert sorted(got, key=str) == sorted([(5, 27, 5, True), (None, 27, 5, False), (None, 27, None, True), (None, 27, None, True), (None, 0, None, True), (6, 27, 5, False)], key=str)


@pytest.mark.parametrize("outside", [1, 40])
def test_cells_grow_with_the_members_outside_the_largest_component(spark, monkeypatch, outside):
    """All pairs of unlike labels meet in just one cell; members of the largest component do not meet each other."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = [(1, i, 0 if i < 1000 else i) for i in range(1000 + outside)]
    members = spark.createDataFrame(rows, "band bigint, id bigint, label bigint")
    grid = neardup._grid(members, members.select("band").distinct()).collect()
    rest = -(-outside // 16)
    assert len(grid) == 1000 * rest + outside * (rest + 63)
    cells = {}
    for r in grid:
        cells.setdefault((r.i, r.j), []).append(r)
    met = Counter()
    for (i, j), own in cells.items():
        for n, a in enumerate(own):
            met.update(tuple(sorted((a.id, b.id))) for b in own[:n] if a.label != b.label and (i == j or a.block != b.block))
    assert set(met.values()) == {1} and len(met) == 1000 * outside + outside * (outside - 1) // 2


def test_signature_estimate():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, (50, 8), dtype=np.uint64)
    b = r.integers(0, 1 << 63, (50, 8), dtype=np.uint64)
    want = [sum((int(x) >> s & 15) == (int(y) >> s & 15) for x, y in zip(p, q) for s in range(0, 64, 4)) for p, q in zip(a, b)]
    assert neardup.equal_lows(a, b).tolist() == want
    assert neardup.collision_corrected(np.array([128, 8])).tolist() == [1.0, 0.0]


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        gone = gone[: len(b)]
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows():
    r = random.Random(5)
    passage = prose(1, 120)  # over 400 bytes
    rows = [(i, t) for i, t in ODD if i != 908]
    for i in range(30):
        own = prose(100 + i, 80, 10**6)
        cut = r.randrange(len(own))
        part = passage[r.randrange(40) : len(passage) - r.randrange(40)]
        rows.append((i, own[:cut] + (part if i % 3 else "") + own[cut:]))
    rows += [(40, "z" * 700), (41, "é" * 200 + "x"), (42, "é" * 200 + "y"), (43, passage[:399]), (44, "q" * 399), (45, "q" * 399)]
    rows += [(50 + i, prose(3, 100)) for i in range(12)]
    return rows


@pytest.mark.parametrize(("chunk", "keys"), [(4 << 20, 1 << 20), (3000, 64)])
def test_repeated_substrings(spark, monkeypatch, chunk, keys):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substrings, "BUCKET_KEYS", keys)
    rows = repeat_rows()
    d = documents(spark, rows).withColumn("chunk", F.lit("mine"))
    got = substrings.repeated_substrings(d)
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(brute_repeats(rows, substrings.LENGTH))
    for r in got.where("n_removed > 0").collect():
        assert sum(r.removed[1::2]) - sum(r.removed[::2]) == r.n_removed and len(r.removed) == 2 * r.n_spans


def test_repeated_substrings_of_nothing(spark):
    assert substrings.repeated_substrings(documents(spark, [])).count() == 0
    r = substrings.repeated_substrings(documents(spark, [(None, None)])).first()
    assert (r.doc_id, r.n_bytes, r.n_removed) == (None, 0, 0)


def test_cover_is_a_difference_cover():
    v, d = substrings.PERIOD, substrings.COVER
    assert sorted((a - b) % v for a in d for b in d if a != b) == list(range(1, v))


def test_hot_text_sends_one_key_a_chunk():
    buf = np.frombuffer(b"ab" * 4000, np.uint8)
    sent = substrings._sent(1, buf, np.arange(len(buf) - 400), 400, 2, True)
    assert sum(len(k) // 8 for k in sent["keys"]) == 2


SQL = {
    "op5_substring_dedup": (substrings.op5_substring_dedup, substrings.ORACLES),
    "op8_minhash_neardup": (neardup.op8_minhash_neardup, neardup.ORACLES),
}


@pytest.mark.parametrize("name", SQL)
def test_driver_tables_equal_sql(spark, data, name):
    query, oracles = SQL[name]
    assert_same(spark, query, oracles[name], data)


@pytest.mark.parametrize("name", SQL)
@pytest.mark.parametrize("content", ["odd", "near", "passages", "empty", "unnamed"])
def test_odd_rows_equal_sql(spark, tmp_path, name, content):
    shared = prose(7, 90)
    rows = {
        "odd": ODD,
        "near": near_rows(),
        "passages": [(i, prose(60 + i, 20 + i) + " " + shared + " " + prose(90 + i, 30)) for i in range(12)] + [(50, "ab" * 500), (51, "é" * 399), (52, "x" + "é" * 399)],
        "empty": [],
        "unnamed": [(None, shared), (3, shared), (None, prose(8, 90)), (None, None), (4, prose(9, 90))],
    }[content]
    query, oracles = SQL[name]
    assert_same(spark, query, oracles[name], folder(spark, tmp_path / "t", rows))
