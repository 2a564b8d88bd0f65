"""Removal of byte strings that occur again: difference-cover sample, then suffix fingerprints sorted bucket by bucket (operator 5).

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too. So suffixes need to be told
apart only up to that length, which is what the difference cover makes cheap in memory and traffic:

1. *Cover sample.* ``COVER`` is a perfect difference cover modulo ``PERIOD``: for any two positions p, q
   there is a shift d < PERIOD that brings both into the sample (positions counted within each text).
   Equal strings of LENGTH bytes at p and q therefore hold equal sample strings of LENGTH - PERIOD + 1
   bytes at p + d and q + d. Only the sample, 14 of 183 positions, is sorted first, and gets ranks: equal
   strings share one, a string found once has none.
2. *Suffixes.* A suffix without a ranked sample in its first PERIOD positions is unique and drops out.
   The rest are dealt to buckets by the leading bits of a fingerprint of their LENGTH bytes.
3. *Buckets* are sorted one at a time, each of bounded size; neighbours that agree are repeats.

This is not a suffix array: the order of suffixes is that of fingerprints rather than of bytes. Nothing but equality is asked for, and
comparing bytes would ship some hundred of them per suffix instead of 8. Fingerprints have 64 bits and, independent of
them, those of the bucket; equal ones are taken for equal strings without a look at the bytes, so among n suffixes that are sent
some n * n / 2 ** (65 + bits of the bucket) pairs are equal by chance: 3e-6 at 158 million suffixes in 256 buckets.

Texts travel in chunks of some megabytes; a chunk sends each distinct key of a bucket once, however
often it holds it, so that a passage shared by a third of all rows adds one key per chunk. Numbers of chunks and buckets, and of the
partitions that they are dealt to, follow from the bytes of the texts.

Cases: a null text is empty; texts under LENGTH bytes are kept whole; overlaps count, also of a string
with itself one byte on (runs); repeated rows remove each other, and stand in one chunk; a text longer than a chunk is a chunk of its own, of
which a task holds some 40 times the bytes; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.functions.scratch import materialize
from kinfolk.llm import common as C
from kinfolk.llm.common import table

LENGTH = 400
PERIOD = 183
# Every number modulo 183 is the difference of exactly one pair of these.
COVER = (0, 1, 3, 16, 23, 28, 42, 76, 82, 86, 119, 137, 154, 175)
CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 20
MOST_PARTITIONS = 20_000

_U = np.uint64
_BLANK = np.zeros(0, np.int64)


def _concat(texts) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or b"" for t in texts]
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offs


def _fingerprints(buf: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    s = C.prefix_hash(buf, C.byte_values(seed))
    return C.mix((s[at + length] - s[at]) * C.powers(len(buf) + 1)[1][at])


def sample_positions(offs: np.ndarray, length: int, period: int, cover: tuple) -> np.ndarray:
    """Cover positions of the texts where a sample string fits; texts under ``length`` bytes have none."""
    out = [_BLANK]
    member = np.zeros(period, bool)
    member[list(cover)] = True
    reach = length - period + 1
    longest = int(np.diff(offs).max(initial=0))
    grid = np.flatnonzero(np.tile(member, longest // period + 1))
    for a, b in zip(offs[:-1], offs[1:]):
        if b - a >= length:
            out.append(a + grid[: np.searchsorted(grid, b - a - reach, "right")])
    return np.concatenate(out)


def _keys(buf: np.ndarray, at: np.ndarray, length: int, bits: int, wide: bool):
    """For each bucket in turn: (bucket, its distinct keys in order, the index of each position's key, positions)."""
    if not len(at):
        return
    h = _fingerprints(buf, at, length, 5)
    own = (_fingerprints(buf, at, length, 6) >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64)
    if not wide:
        h = (h >> _U(32)).astype(np.uint32)
    order = np.argsort(own, kind="stable")
    own = own[order]
    edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    for a, b in zip(edges, np.r_[edges[1:], len(own)]):
        keys, inverse = np.unique(h[order[a:b]], return_inverse=True)
        yield int(own[a]), keys, inverse, at[order[a:b]]


def _sent(chunk, buf, at, length, bits, wide) -> pd.DataFrame:
    rows = [(b, chunk, keys.tobytes()) for b, keys, _, _ in _keys(buf, at, length, bits, wide)]
    return pd.DataFrame(rows, columns=["bucket", "chunk", "keys"])


def _sort_bucket(pdf: pd.DataFrame, wide: bool) -> pd.DataFrame:
    """Sort the keys of one bucket; bits say which of a chunk's keys another chunk has as well."""
    kind = np.uint64 if wide else np.uint32
    parts = [np.frombuffer(k, kind) for k in pdf["keys"]]
    size = [len(p) for p in parts]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    flag = np.zeros(len(s), bool)
    flag[order] = same
    bits = [np.packbits(f).tobytes() for f in np.split(flag, np.cumsum(size)[:-1])]
    return pd.DataFrame({"to": pdf.chunk.values, "bucket": pdf.bucket.values, "bits": bits})


def _repeated(buf, at, length, bits, wide, flags: pd.DataFrame) -> np.ndarray:
    """Positions whose string occurs again, in this chunk or by the flags of the buckets in another."""
    by = dict(zip(flags.bucket, flags.bits)) if len(flags) else {}
    out = [_BLANK]
    for b, keys, inverse, pos in _keys(buf, at, length, bits, wide):
        again = np.bincount(inverse, minlength=len(keys)) > 1
        if b in by:
            again |= np.unpackbits(np.frombuffer(by[b], np.uint8), count=len(keys)).astype(bool)
        out.append(pos[again[inverse]])
    return np.concatenate(out)


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["doc_id", "text"], kind="stable", na_position="first")


def _alive(key, pdf: pd.DataFrame, flags: pd.DataFrame, bits: int) -> pd.DataFrame:
    """The chunk as one row: texts that hold candidates, with the runs of these, and digests of the others."""
    pdf = _ordered(pdf)
    buf, offs = _concat(pdf.text)
    at = sample_positions(offs, LENGTH, PERIOD, COVER)
    hit = _repeated(buf, at, LENGTH - PERIOD + 1, bits, False, flags)
    d = np.searchsorted(offs, hit, "right") - 1
    low = np.maximum(hit - PERIOD + 1, offs[d])
    high = np.minimum(hit, offs[d + 1] - LENGTH) + 1
    mask = _covered(len(buf), low[low < high], high[low < high])
    starts, ends = _runs(mask)
    open_ = np.zeros(len(pdf), bool)
    open_[np.searchsorted(offs, starts, "right") - 1] = True
    size = np.diff(offs)
    moved = np.zeros(len(pdf), np.int64)
    moved[open_] = np.r_[0, np.cumsum(size[open_])[:-1]][: open_.sum()] - offs[:-1][open_]
    shift = moved[np.searchsorted(offs, starts, "right") - 1]
    ids, texts = pdf.doc_id.tolist(), pdf.text.tolist()
    ids = [None if pd.isna(i) else int(i) for i in ids]
    row = {
        "chunk": key[0],
        "ids": [i for i, o in zip(ids, open_) if o],
        "sizes": size[open_].tolist(),
        "text": b"".join(t or b"" for t, o in zip(texts, open_) if o),
        "starts": (starts + shift).tobytes(),
        "ends": (ends + shift).tobytes(),
        "n": int((ends - starts).sum()),
        "done_ids": [i for i, o in zip(ids, open_) if not o],
        "done_sizes": size[~open_].tolist(),
        "done_sha": [hashlib.sha256(t or b"").hexdigest() for t, o in zip(texts, open_) if not o],
    }
    C.give_back()
    return pd.DataFrame([row])


ALIVE = "chunk bigint, ids array<bigint>, sizes array<bigint>, text binary, starts binary, ends binary, n bigint, done_ids array<bigint>, done_sizes array<bigint>, done_sha array<string>"


def _positions(row) -> np.ndarray:
    a, b = np.frombuffer(row.starts, np.int64), np.frombuffer(row.ends, np.int64)
    n = b - a
    return np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(a) else _BLANK


def _finish(key, pdf: pd.DataFrame, flags: pd.DataFrame, bits: int) -> pd.DataFrame:
    row = pdf.iloc[0]
    buf = np.frombuffer(row.text, np.uint8)
    hit = _repeated(buf, _positions(row), LENGTH, bits, True, flags)
    gone = _covered(len(buf), hit, hit + LENGTH)
    out = [(i, n, 0, 0, sha, []) for i, n, sha in zip(row.done_ids, row.done_sizes, row.done_sha)]
    at = 0
    for i, n in zip(row.ids, row.sizes):
        n = int(n)
        mask = gone[at : at + n]
        a, b = _runs(mask)
        kept = buf[at : at + n][~mask].tobytes()
        out.append((i, n, int(mask.sum()), len(a), hashlib.sha256(kept).hexdigest(), np.stack([a, b], 1).ravel().tolist()))
        at += n
    f = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])
    f["doc_id"] = f.doc_id.astype("Int64")
    C.give_back()
    return f


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<bigint>"


def _bits(keys: float) -> int:
    return max(0, math.ceil(math.log2(max(keys, 1) / BUCKET_KEYS)))


def _dealt(sent: DataFrame, bits: int) -> DataFrame:
    return sent.repartition(min(1 << bits, MOST_PARTITIONS), "bucket")


def repeated_substrings(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``; ``removed`` lists start, end, start, end, ... in bytes."""
    raw = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = raw.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / CHUNK_BYTES))
    dealt = raw.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(min(chunks, MOST_PARTITIONS), "chunk")
    few = _bits(total * len(COVER) / PERIOD)

    def sample(key, pdf):
        buf, offs = _concat(_ordered(pdf).text)
        return _sent(key[0], buf, sample_positions(offs, LENGTH, PERIOD, COVER), LENGTH - PERIOD + 1, few, False)

    sent = dealt.groupBy("chunk").applyInPandas(sample, "bucket bigint, chunk bigint, keys binary")
    ranks = _dealt(sent, few).groupBy("bucket").applyInPandas(lambda pdf: _sort_bucket(pdf, False), "to bigint, bucket bigint, bits binary")
    alive = dealt.groupBy("chunk").cogroup(ranks.groupBy("to")).applyInPandas(lambda k, p, f: _alive(k, p, f, few), ALIVE)
    alive = materialize(alive)
    many = _bits(alive.agg(F.sum("n")).first()[0] or 0)

    def suffixes(it):
        for pdf in it:
            for row in pdf.itertuples():
                yield _sent(row.chunk, np.frombuffer(row.text, np.uint8), _positions(row), LENGTH, many, True)

    sent = alive.where("n > 0").select("chunk", "text", "starts", "ends").mapInPandas(suffixes, "bucket bigint, chunk bigint, keys binary")
    marks = _dealt(sent, many).groupBy("bucket").applyInPandas(lambda pdf: _sort_bucket(pdf, True), "to bigint, bucket bigint, bits binary")
    return alive.groupBy("chunk").cogroup(marks.groupBy("to")).applyInPandas(lambda k, p, f: _finish(k, p, f, many), RESULT)


def _oracle() -> str:
    """Ranks of the strings of 16, 32, ... bytes at every position from those of half the length; two of the longest make up LENGTH."""
    step = "SELECT r, p, n, v, {} FROM {} WINDOW w AS (PARTITION BY r ORDER BY p)"
    parts = {
        "texts": "SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS bytes FROM documents",
        "b1": "SELECT r, unnest(range(octet_length(bytes))) AS p, octet_length(bytes) AS n, unnest(regexp_extract_all(hex(bytes), '..')) AS v FROM texts",
        "b4": step.format("concat(v, lead(v, 1) OVER w, lead(v, 2) OVER w, lead(v, 3) OVER w) AS s", "b1"),
        "b16": step.format("concat(s, lead(s, 4) OVER w, lead(s, 8) OVER w, lead(s, 12) OVER w) AS s", "b4"),
        "k16": "SELECT r, p, n, v, dense_rank() OVER (ORDER BY s) AS k FROM b16",
    }
    size = 16
    while size * 2 <= LENGTH:
        parts[f"s{size * 2}"] = step.format(f"k, lead(k, {size}) OVER w AS k2", f"k{size}")
        parts[f"k{size * 2}"] = f"SELECT r, p, n, v, dense_rank() OVER (ORDER BY k, k2) AS k FROM s{size * 2}"
        size *= 2
    parts["whole"] = step.format(f"k, lead(k, {LENGTH - size}) OVER w AS k2, p + {LENGTH} <= n AS fits", f"k{size}")
    parts["found"] = "SELECT r, p, v, fits AND count(*) FILTER (fits) OVER (PARTITION BY k, k2) > 1 AS again FROM whole"
    parts["bytes_gone"] = f"SELECT r, p, v, bool_or(again) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM found"
    parts["edges"] = "SELECT r, p, v, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM bytes_gone"
    parts["sums"] = (
        "SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, "
        "string_agg(v, '' ORDER BY p) FILTER (NOT gone) AS kept FROM edges GROUP BY r"
    )
    listed = ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items())
    return f"""
WITH {listed}
SELECT doc_id, octet_length(bytes) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM texts LEFT JOIN sums USING (r)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents")).drop("removed")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES = {"op5_substring_dedup": _oracle()}
