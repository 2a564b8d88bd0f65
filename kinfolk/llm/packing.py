"""Packing token sequences by minimum bin slack (operator 7).

Every text is tokenized whole. Lengths of at least one window give full pieces, the remainder one more
piece. The plan needs only how many pieces there are of each length, at most ``WINDOW`` numbers: for
each new window a subset-sum over the remaining lengths (one big integer as a bit set per length) finds the
reachable fill closest to the window, counts are traced back, and the pattern so found is used as often as
the counts allow. Pieces are then ranked within their length by a two-level prefix sum, and a
piece's rank gives its window and offset by arithmetic: no task gathers the pieces of a length, however
many there are.

Cases: a null or empty text is its end mark alone; texts of any length are cut, nothing is dropped;
repeated rows are packed each; no rows give no pieces; extra columns are ignored. Among equal pieces
the order is free and changes no result.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfolk.functions.scratch import materialize
from kinfolk.llm.common import give_back, stretches, table, text_bytes

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Bytes of words, and of the tables that find them, that a Python worker keeps at hand: some 100,000 words.
WORD_CACHE = 16 << 20
#: Bytes of a word's entry besides its letters.
ENTRY_BYTES = 140
LONGEST_WORD = 10_000
BLOCK_BYTES = 2 << 20
CELL_ROWS = 512


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    # threads of the library would take cores that other tasks hold
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: A letter, marks after it and the white space that ends the word. The pre-tokenizer parts letters and marks anyway.
_WORD_END = r"(\pL)([.,;:!?|%$#*&()]+)(\s|$)"


def _byte_letters() -> dict[int, str]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others for those from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class WordTokenizer:
    """Ids of texts, word by word: this vocabulary's pre-tokenizer never joins across ASCII white space.

    Case and marks at word ends are taken off first, as the vocabulary does itself, which leaves fewer
    distinct words. Each is tokenized once and its ids are kept for later texts; the ids of the texts
    are then gathered as arrays. A text that holds a special token's mark is tokenized as it stands.
    """

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.store, self.sizes = array("H"), array("H")

    def _keep(self, word: str, ids: list[int]) -> None:
        self.known[word] = len(self.sizes)
        self.held += ENTRY_BYTES + 2 * len(word)
        self.sizes.append(len(ids))
        self.store.extend(ids)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words in the store; words not seen before are tokenized and added."""
        if self.held > WORD_CACHE:
            self.forget()
        known = self.known
        new = [w for w in words if w not in known]
        merge, odd = self.tok.model.tokenize, []
        for w in new:
            # a word of letters in normal form is one unit already, so its merges can be asked for directly
            if w.isalpha() and (w.isascii() or (w.lower() == w and is_normalized("NFC", w))):
                name = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS)
                self._keep(w, [t.id for t in merge(name)])
            else:
                odd.append(w)
        for k in range(0, len(odd), 10_000):
            part = odd[k : k + 10_000]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                self._keep(w, e.ids)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def block(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column without nulls."""
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), _WORD_END, r"\1 \2\3")
        split = pc.ascii_split_whitespace(plain)
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        # a word of more ids than the store's sizes can hold is no word: such texts go the plain way
        long = {w for w in words if len(w) > LONGEST_WORD}
        index = self._numbers([w if w not in long else "" for w in words])[coded.indices.to_numpy(zero_copy_only=False)]
        size = np.frombuffer(self.sizes, np.uint16).astype(np.int64) if len(self.sizes) else np.zeros(0, np.int64)
        first = np.cumsum(size) - size
        store = np.frombuffer(self.store, np.uint16) if len(self.store) else np.zeros(0, np.uint16)
        n = size[index]
        ends = np.cumsum(n)
        flat = store[np.repeat(first[index] - (ends - n), n) + np.arange(int(n.sum()))].astype(np.uint32)
        at = np.r_[0, ends][np.cumsum(counts)]
        out = np.split(flat, at[:-1]) if len(at) else []
        plainly = set()
        for m in self.marks:
            plainly.update(np.flatnonzero(pc.match_substring(texts, m).to_numpy(zero_copy_only=False)).tolist())
        if long:
            plainly.update(i for i, ws in enumerate(split) if any(w in long for w in ws.as_py()))
        for i in plainly:
            out[i] = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.block(pa.array([text], pa.large_string()))[0]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer; it keeps its vocabulary from task to task, and its words within one."""
    return WordTokenizer(path)


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cut(batches: Iterator[pa.RecordBatch], path: str, window: int, keep_ids: bool):
    tok = word_tokenizer(path)
    for b in batches:
        rows: list[list] = [[], [], [], [], [], []]
        names = b.column(0).to_pylist()
        parts = ((i, tok.block(part)) for i, part in stretches(b.column(1), BLOCK_BYTES))
        for doc_id, ids in ((names[i + k], ids) for i, each in parts for k, ids in enumerate(each)):
            ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
            for start in range(0, len(ids), window):
                piece = ids[start : start + window]
                raw = piece.tobytes()
                for col, v in zip(rows, (doc_id, start, len(piece), zlib.crc32(raw), len(ids), raw)):
                    col.append(v)
        cols = [pa.array(c, pa.int64()) for c in rows[:5]] + ([pa.array(rows[5], pa.binary())] if keep_ids else [])
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])
    tok.forget()
    give_back()


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``BLOCK_BYTES`` of text, so that the ids of a whole batch are never held at once."""
    for b in batches:
        _, offs = text_bytes(b.column(1))
        i, n = 0, b.num_rows
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK_BYTES, "right")) - 1))
            yield b.slice(i, j - i)
            i = j


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, keep_ids: bool = True) -> DataFrame:
    """Pieces of every document of ``docs(doc_id, text)``; ``ids`` holds little-endian unsigned 32-bit ids."""
    path = path or vocabulary_path()
    schema = PIECES + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda it: _cut(_small(it), path, window, keep_ids), schema)


def best_fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """Length -> number of pieces of one window with the least slack that holds the longest piece left.

    ``reach[k]`` is a bit set of the sums that the first k items give. Traced back from the largest sum. The pieces of a
    length are items of 1, 2, 4, ... pieces and the rest, which give every number of them with few shifts.
    """
    longest = max(counts)
    lengths = sorted((x for x in counts if x <= window - longest), reverse=True)
    full = (1 << (window + 1)) - 1
    reach = [1 << longest]
    used: list[tuple[int, int, int]] = []
    for x in lengths:
        most, item = min(counts[x] - (x == longest), (window - longest) // x), 1
        while most > 0 and not reach[-1] >> window & 1:
            n = min(item, most)
            most, item = most - n, 2 * item
            before = reach[-1]
            now = (before | before << n * x) & full
            if now == before:
                continue
            used.append((x, n, len(reach)))
            reach.append(now)
        if reach[-1] >> window & 1:
            break
    total = reach[-1].bit_length() - 1
    pattern = {longest: 1}
    for x, n, k in reversed(used):
        if not reach[k - 1] >> total & 1:
            total -= n * x
            pattern[x] = pattern.get(x, 0) + n
    return pattern


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(number of windows, pieces by length of each) that use up ``counts``; at most some 4 * window entries."""
    left = {x: n for x, n in counts.items() if n > 0}
    out = []
    while left:
        pattern = best_fill(left, window)
        times = min(left[x] // n for x, n in pattern.items())
        out.append((times, pattern))
        for x, n in pattern.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
    return out


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Length -> rows (first rank, first window, pieces in each window, offset of the first of them)."""
    slots: dict[int, list] = {}
    ranks: dict[int, int] = {}
    window = 0
    for times, pattern in patterns:
        offset = 0
        for x in sorted(pattern, reverse=True):
            n = pattern[x]
            slots.setdefault(x, []).append((ranks.get(x, 0), window, n, offset))
            ranks[x] = ranks.get(x, 0) + times * n
            offset += n * x
        window += times
    return {x: np.array(v, np.int64) for x, v in slots.items()}


def _place(it: Iterator[pd.DataFrame], slots: dict[int, np.ndarray]):
    for pdf in it:
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        length, place = pdf.length.values, pdf["rank"].values
        for x in np.unique(length):
            own = length == x
            s = slots[int(x)]
            row = s[np.searchsorted(s[:, 0], place[own], "right") - 1]
            inner = place[own] - row[:, 0]
            seq[own] = row[:, 1] + inner // row[:, 2]
            off[own] = row[:, 3] + inner % row[:, 2] * x
        yield pdf.drop(columns="rank").assign(sequence_id=seq, offset=off)


def ranked(cut: DataFrame, total: int) -> DataFrame:
    """Pieces with ``rank``, their place (from 0) among those of their length.

    Within a length pieces are in order of a hash. Its leading bits deal them to cells of some 512
    pieces; cell counts are summed up per length, and a window ranks the pieces of a cell.
    """
    bits = max(0, math.ceil(math.log2(max(total, 1) / CELL_ROWS)))
    key = F.xxhash64("doc_id", "start")
    cell = F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("bigint")
    d = cut.withColumn("__key", key).withColumn("__cell", cell)
    before = F.sum("n").over(W.partitionBy("length").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1))
    cells = d.groupBy("length", "__cell").agg(F.count("*").alias("n")).select("length", "__cell", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("length", "__cell").orderBy("__key", "doc_id", "start", "ids_crc32"))
    d = d.join(cells, ["length", "__cell"]).withColumn("rank", F.col("__before") + inside - 1)
    return d.select(*cut.columns, "rank")


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces. ``cut`` is read more than once: pass a table."""
    counts = {int(x): int(n) for x, n in cut.groupBy("length").count().collect()}  # at most ``window`` rows
    slots = _slots(plan(counts, window))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked(cut, sum(counts.values())).mapInPandas(lambda it: _place(it, slots), schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(materialize(pieces(docs, keep_ids=False))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict = {}
