"""MinHash near-duplicates with b-bit signatures (operator 8).

1. *Signatures.* Each whole text becomes its set of distinct word shingles, held as 64-bit hashes. 128
   minima give 32 bands of 4, and of each minimum the low 4 bits are packed into a 64-byte signature.
   Texts with the same set form a class; the class of the smallest id stands for it from here on.
2. *Candidates.* Classes that share a band are candidates (two sets at the threshold share none with a
   chance of 5e-8). In every band bucket each member is paired with one leader only, in a few rounds
   with other leaders; buckets whose members are linked already drop out.
3. *Estimate.* The share of equal low bits, corrected for chance collisions, is counted on the packed
   signatures; pairs far below the threshold (over five standard deviations) go.
4. *Confirmation* on the full sets: exact intersection and union sizes.
5. *Rest.* In buckets that still hold unlinked members, the members of the largest component meet the others, and these meet
   each other, in cells of two blocks of bounded size; members of one component do not meet again. Sets of members in pairs
   near the threshold are brought to the cell, which confirms the pairs in place and emits links only: no pair is
   lost and none becomes a row. A bucket of m members with r outside its largest component sends some m * r / BLOCK rows.
6. Links are contracted to components, by star steps over tables unless they are few.

Cases: null and wordless texts have an empty set and stay single; repeated rows share a class; a group
of copies of any size is one class and adds one row; very long texts are hashed whole; an empty table
gives an empty result; other input columns are ignored. A row without an id cannot stand for others: it takes the
component of the rows with its set and is not kept if there are any with ids, else its component is null and it is kept. An id is taken
to name one text: of rows with one id and different texts, which text is confirmed against others is not defined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.functions.scratch import materialize
from kinfolk.llm import common as C
from kinfolk.llm.common import table
from kinfolk.operators.components import component_labels

MINIMA, BANDS, ROWS, BITS = 128, 32, 4, 4
LEADER_ROUNDS = 2
BLOCK = 512
#: Sets of followers that meet their leader in one task.
FOLLOWERS = 128
#: Standard deviation of the estimate at the threshold, times five and a half, is some 0.2.
MARGIN = 0.2
#: The query's own shingles and threshold.
SHINGLE_WORDS, PERCENT = 4, 80
#: Ids of 8 bytes that are broadcast: 16 MB.
BROADCAST_IDS = 2_000_000

_U = np.uint64


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(8)
    return r.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * _U(2) + _U(1), r.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of the texts, in order, and the n + 1 offsets of the texts.

    A text with fewer than k words, but some, has one shingle of them all.
    """
    starts, ends, at = C.word_spans(buf, offs)
    if lower:
        buf = C.lower_ascii(buf)
    s = C.prefix_hash(buf, C.byte_values(1))
    h = C.mix((s[ends] - s[starts]) * C.powers(len(buf) + 1)[1][starts])
    n = np.diff(at)
    mult = C.byte_values(2)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    if not len(h):
        return np.zeros(0, np.uint64), out
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        rolled += h[j : len(h) - k + 1 + j] * mult[j]
    result = np.zeros(out[-1], np.uint64)
    full = np.repeat(n >= k, count)
    inner = np.arange(out[-1]) - np.repeat(out[:-1], count)
    first = np.repeat(at[:-1], count) + inner
    result[full] = rolled[first[full]]
    for d in np.flatnonzero((n > 0) & (n < k)):
        own = h[at[d] : at[d + 1]]
        result[out[d]] = ((own * mult[: len(own)]).sum(keepdims=True) + mult[[100 + len(own)]])[0]
    return C.mix(result), out


def _hash_rows(batches, k: int):
    a, c = _family()
    lanes = (1 << (np.arange(0, 64 // BITS) * BITS)).astype(np.uint64)
    for b in batches:
        buf, offs = C.text_bytes(b.column(1))
        cols: list[list] = [[], [], [], [], []]
        ids = b.column(0)
        for i, j, part, o in C.blocks(buf, offs):
            x, at = shingle_hashes(part, o, k)
            n = np.diff(at)
            some = np.flatnonzero(n)
            minima = np.zeros((len(n), MINIMA), np.uint64)
            if len(some):
                heads = at[:-1][some]
                for h in range(MINIMA):
                    minima[some, h] = np.minimum.reduceat((x ^ c[h]) * a[h], heads)
            bands = C.mix(minima.reshape(len(n), BANDS, ROWS) * C.byte_values(3)[:ROWS]).sum(axis=2, dtype=np.uint64)
            bands = C.mix(bands ^ np.arange(BANDS, dtype=np.uint64))
            low = ((C.mix(minima) & _U((1 << BITS) - 1)).reshape(len(n), -1, 64 // BITS) * lanes).sum(axis=2, dtype=np.uint64)
            for d in range(len(n)):
                own = np.unique(x[at[d] : at[d + 1]])
                cols[1].append(len(own))
                cols[2].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else b"")
                cols[3].append(bands[d].view(np.int64))
                cols[4].append(low[d].tobytes())
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
             pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary())],
            names=["doc_id", "n_shingles", "digest", "bands", "low"],
        )
    C.give_back()


def signatures(docs: DataFrame, k: int) -> DataFrame:
    schema = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, low binary"
    return docs.select("doc_id", "text").mapInArrow(lambda it: _hash_rows(it, k), schema)


def _set_rows(batches, k: int):
    for b in batches:
        buf, offs = C.text_bytes(b.column(1))
        sets: list = []
        for _, _, part, o in C.blocks(buf, offs):
            x, at = shingle_hashes(part, o, k)
            sets += [np.unique(x[at[d] : at[d + 1]]).tobytes() for d in range(len(at) - 1)]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["id", "hashes"])
    C.give_back()


def collision_corrected(equal: np.ndarray, total: int = MINIMA, bits: int = BITS) -> np.ndarray:
    """Similarity from the number of equal low parts: chance makes 2**-bits of unlike minima equal."""
    chance = 2.0**-bits
    return (equal / total - chance) / (1 - chance)


def equal_lows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal 4-bit parts of packed rows of uint64: fold each part's differing bits to one bit and count."""
    x = a ^ b
    x |= x >> _U(2)
    x |= x >> _U(1)
    x &= _U(0x1111111111111111)
    return MINIMA - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _words_of(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint64).reshape(len(col), -1)


def _near(batches, cut: float):
    for pdf in batches:
        if len(pdf):
            est = collision_corrected(equal_lows(_words_of(pdf.a_low), _words_of(pdf.b_low)))
            yield pdf.loc[est >= cut, ["a", "b"]]


def _confirm(key, members: pd.DataFrame, leader: pd.DataFrame, percent: int) -> pd.DataFrame:
    lead = np.frombuffer(leader.lead_hashes.iloc[0], np.uint64) if len(leader) else np.zeros(0, np.uint64)
    keep = []
    for m in members.hashes:
        own = np.frombuffer(m, np.uint64)
        if min(len(own), len(lead)) * 100 < percent * max(len(own), len(lead)) or not len(lead):
            keep.append(False)
            continue
        at = np.searchsorted(lead, own)
        at[at == len(lead)] = 0
        both = int((lead[at] == own).sum())
        keep.append(100 * both >= percent * (len(own) + len(lead) - both))
    return pd.DataFrame({"src": key[0], "dst": members.b[np.array(keep, bool)]}).astype("int64")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the threshold, as (src, dst).

    A leader's set goes once to each part of its followers, of ``FOLLOWERS`` or so; a follower's set goes along
    with its pair. So a leader of very many is dealt to many tasks and each holds few sets at a time.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    members = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "hashes")
    leaders = parts.join(sets.withColumnRenamed("id", "a"), "a").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    leaders = leaders.select(F.col("a").alias("lead"), F.col("part").alias("lead_part"), F.col("hashes").alias("lead_hashes"))
    members = members.select(F.col("a").alias("a"), F.col("part").alias("part"), F.col("b").alias("b"), F.col("hashes").alias("hashes"))
    return (
        members.groupBy("a", "part")
        .cogroup(leaders.groupBy("lead", "lead_part"))
        .applyInPandas(lambda key, m, lead: _confirm(key, m, lead, percent), "src bigint, dst bigint")
    )


def _estimated(pairs: DataFrame, lows: DataFrame, cut: float) -> DataFrame:
    p = pairs.join(lows.select(F.col("id").alias("a"), F.col("low").alias("a_low")), "a")
    p = p.join(lows.select(F.col("id").alias("b"), F.col("low").alias("b_low")), "b").select("a", "b", "a_low", "b_low")
    return p.mapInPandas(lambda it: _near(it, cut), "a bigint, b bigint")


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of the rows of one key each, from batches in which equal keys stand together."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        edges = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1]
        for x, y in zip(edges[:-1], edges[1:]):
            yield pdf.iloc[x:y]
        rest = pdf.iloc[edges[-1] :]
    if rest is not None:
        yield rest


CELL = ["band", "i", "j"]
CELLS = "band bigint, i int, j int, pos int, id bigint, pairs binary"


def _cells(batches: Iterator[pd.DataFrame], cut: float) -> Iterator[pd.DataFrame]:
    """Of each cell (two blocks of a bucket) the members in pairs to confirm; the first row holds the pairs.

    A pair is taken if its labels differ, the estimate lets it pass and the bucket is the first that the two share.
    """
    out: list[tuple] = []
    for pdf in _runs(batches, CELL):
        band, i, j = int(pdf.band.iloc[0]), int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        x = pdf if i == j else pdf[pdf.block == i]
        y = pdf if i == j else pdf[pdf.block == j]
        if not len(x) or not len(y):
            continue
        unlike = x.label.values[:, None] != y.label.values[None, :]
        if i == j:
            unlike = np.triu(unlike, 1)
        r, c = np.nonzero(unlike)
        if not len(r):
            continue
        lx, ly = _words_of(x.low), _words_of(y.low)
        bx, by = np.stack(x.bands.to_list()), np.stack(y.bands.to_list())
        near = []
        for k in range(0, len(r), 1 << 16):
            p, q = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
            own = collision_corrected(equal_lows(lx[p], ly[q])) >= cut
            p, q = p[own], q[own]
            same = bx[p] == by[q]
            first = bx[p, same.argmax(axis=1)] == band
            near.append(np.stack([p[first], q[first]], 1))
        pairs = np.concatenate(near)
        if len(pairs):
            a, pa_ = np.unique(pairs[:, 0], return_inverse=True)
            b, pb_ = np.unique(pairs[:, 1], return_inverse=True)
            ids = [*x.id.values[a], *y.id.values[b]]
            packed = np.stack([pa_, pb_ + len(a)], 1).astype("<u2").tobytes()
            out += [(band, i, j, n, int(v), packed if n == 0 else None) for n, v in enumerate(ids)]
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=[*CELL, "pos", "id", "pairs"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=[*CELL, "pos", "id", "pairs"])


def _confirm_cells(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for pdf in _runs(batches, CELL):
        pdf = pdf.sort_values("pos")
        ids = pdf.id.values
        sets = [np.frombuffer(h, np.uint64) for h in pdf.hashes]
        size = np.array([len(s) for s in sets])
        pairs = np.frombuffer(pdf.pairs.iloc[0], "<u2").reshape(-1, 2).astype(np.int64)
        pairs = pairs[np.minimum(size[pairs[:, 0]], size[pairs[:, 1]]) * 100 >= percent * np.maximum(size[pairs[:, 0]], size[pairs[:, 1]])]
        found: list[tuple] = []
        for a in np.unique(pairs[:, 0]):
            others = pairs[pairs[:, 0] == a, 1]
            every = np.concatenate([sets[b] for b in others])
            at = np.searchsorted(sets[a], every)
            at[at == size[a]] = 0
            heads = np.r_[0, np.cumsum(size[others])[:-1]]
            both = np.add.reduceat((sets[a][at] == every).astype(np.int64), heads)
            ok = 100 * both >= percent * (size[a] + size[others] - both)
            found += [(ids[a], ids[b]) for b in others[ok]]
        if found:
            yield pd.DataFrame(found, columns=["src", "dst"]).astype("int64")


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    b = buckets.join(labels.withColumnRenamed("component_id", "label"), "id", "left")
    return b.withColumn("label", F.coalesce("label", "id"))


def _grid(members: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows of the cells (band, i, j) of the buckets in ``open_``: one for each cell that a member takes part in.

    Blocks 0 to r - 1 hold the members outside the largest component of a bucket, the blocks after them those of it. Cells are the pairs
    of blocks of which one is among the first r.
    """
    sizes = members.join(open_.select("band"), "band").groupBy("band", "label").agg(F.count("*").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    each = sizes.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    each = materialize(each.select("band", "main", blocks(F.col("all") - F.col("most")).alias("rest"), blocks(F.col("most")).alias("mains")))
    d = members.join(each, "band").withColumn("in_main", F.col("label") == F.col("main"))
    key = F.xxhash64("id")
    block = F.when(F.col("in_main"), F.col("rest") + F.pmod(key, F.col("mains"))).otherwise(F.pmod(key, F.col("rest"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("in_main"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)
    both = F.transform(others, lambda q: F.struct(F.least("block", q).alias("i"), F.greatest("block", q).alias("j")))
    return d.withColumn("block", block).withColumn("p", F.explode(both)).select("band", "p.i", "p.j", "id", "label", "block")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Two rows are linked if their sets of k-word shingles (ASCII letters lowered) have at least
    ``percent`` of their union in common.
    """
    cut = percent / 100 - MARGIN
    rows = materialize(signatures(docs, k))
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(some.groupBy("digest").agg(F.min(F.struct("doc_id", "bands", "low")).alias("m")).select("digest", "m.*").withColumnRenamed("doc_id", "id"))
    lows = classes.select("id", "low")
    banded = classes.select("id", F.explode("bands").alias("band"))
    # tables of one row a band are written first: a join with them can then be split where a band is very frequent
    full = materialize(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"))
    buckets = materialize(banded.join(full, "band"))
    wanted = materialize(buckets.select("id").distinct())
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    chosen = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id")
    sets = materialize(chosen.mapInArrow(lambda it: _set_rows(it, k), "id bigint, hashes binary").dropDuplicates(["id"]))

    links = None
    labels = docs.sparkSession.createDataFrame([], "id bigint, component_id bigint")
    tried = None
    for round_ in range(LEADER_ROUNDS + 1):
        members = materialize(_labelled(buckets, labels))
        order = F.col("id") if round_ == 0 else F.xxhash64(F.col("id"), F.lit(round_))
        stats = members.groupBy("band").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
            F.min_by(F.struct("id", "label"), F.struct(order, "id")).alias("m"),
        )
        stats = materialize(stats.where("lo <> hi").select("band", "blocks", F.col("m.id").alias("lead"), F.col("m.label").alias("lead_label")))
        if stats.isEmpty():
            break
        if round_ < LEADER_ROUNDS:
            pairs = members.join(stats, "band").where("label <> lead_label").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
            near = _estimated(pairs.distinct(), lows, cut)
            near = materialize(near if tried is None else near.join(tried, ["a", "b"], "left_anti"))
            tried = near
            found = confirm(near, sets, percent)
        else:
            grid = _grid(members, stats).join(classes.select("id", "low", "bands"), "id")
            cells = grid.repartition(*CELL).sortWithinPartitions(*CELL).mapInPandas(lambda it: _cells(it, cut), CELLS)
            held = materialize(cells).join(sets, "id")
            found = held.repartition(*CELL).sortWithinPartitions(*CELL).mapInPandas(lambda it: _confirm_cells(it, percent), "src bigint, dst bigint")
        found = materialize(found)
        links = found if links is None else links.unionByName(found)
        labels = materialize(component_labels(links))
    by_class = classes.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _oracle(k: int, percent: int) -> str:
    """All pairs of classes that share a shingle, counted, and what is reachable over links."""
    return rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END)) AS shingles
    FROM texts
), classes AS (
    SELECT min(doc_id) AS id, shingles, len(shingles) AS n
    FROM sets WHERE len(shingles) > 0 AND doc_id IS NOT NULL GROUP BY shingles
), members AS (
    SELECT id, n, unnest(shingles) AS shingle FROM classes
), pairs AS (
    SELECT a.id AS a, b.id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS shared
    FROM members a JOIN members b ON a.shingle = b.shingle AND a.id < b.id
    WHERE 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
    GROUP BY a.id, b.id
), links AS (
    SELECT a, b FROM pairs WHERE 100 * shared >= {percent} * (total - shared)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(id, other) AS (
    SELECT id, id FROM classes
    UNION
    SELECT r.id, l.b FROM reached r JOIN both_ways l ON l.a = r.other
), components AS (
    SELECT c.shingles, min(r.other) AS component_id
    FROM classes c JOIN reached r ON r.id = c.id GROUP BY c.shingles
)
SELECT s.doc_id, len(s.shingles) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
       s.doc_id IS NOT DISTINCT FROM coalesce(c.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN components c ON c.shingles = s.shingles
"""


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=SHINGLE_WORDS, percent=PERCENT)


QUERIES = {"op8_minhash_neardup": op8_minhash_neardup}
ORACLES = {"op8_minhash_neardup": _oracle(SHINGLE_WORDS, PERCENT)}
