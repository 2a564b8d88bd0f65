"""Quality rules: a threshold table compiled into one projection (operator 1).

``RULES`` is data: each row names a ratio and the closed range in which a clean text lies. ``judge``
turns the table into boolean columns of one projection over built-in functions, so that a scan, the
projection and nothing else stand in the plan: no exchange, no user function, no row order.

Cases: a null or empty text has 0 words and fails the base rule; ratios divide by at least 1; repeated
rows are judged one by one; further input columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.llm.common import SPACE_CHARS, table, without_spaces, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that with for was on be are as at by it from this an or a "
    "der die das und zu den von mit ist des auf im dem nicht ein eine als auch "
    "le la les de et en un une du que dans pour qui sur par au est "
    "el los las y del se por con una para al lo como no"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    ratio: str
    least: float
    most: float


RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols / n_words", 0.0, 0.1),
    Rule("emphasis", "n_exclaims / n_words", 0.0, 0.2),
    Rule("stop_words", "n_stop_words / n_words", 0.04, 1.0),
    Rule("repeated_lines", "n_dup_lines / n_lines", 0.0, 0.5),
    Rule("line_length", "n_words / n_lines", 2.0, 5000.0),
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def repeat_words(w: Column) -> Column:
    """Words of an array that lie in a 3-word window found twice or more.

    Windows stand as 64-bit hashes of their words. Where all differ, none repeats, which settles most
    texts. Else they are sorted with their positions; those equal to a neighbour are repeated. Over the
    sorted positions of the repeated ones, each adds the words up to the next one, 3 at most.
    """
    hashes = _let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda h: F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)),
        ),
    )

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)

    def repeated(t: Column) -> Column:
        dealt = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of(s: Column) -> Column:
            marked = F.transform(
                s,
                lambda x, k: F.when(
                    (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]
                ),
            )
            return _let(F.sort_array(F.filter(marked, lambda i: i.isNotNull())), covered)

        return _let(dealt, of)

    return _let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(repeated(h)),
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts that the rules use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), words(F.col(text_col)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: without_spaces(x) != "")
    return base.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(without_spaces(F.col("t"))).cast("bigint").alias("word_chars"),
        _count_chars(F.col("t"), SYMBOLS).alias("n_symbols"),
        _count_chars(F.col("t"), "!").alias("n_exclaims"),
        _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("l"),
        F.size(F.filter("w", lambda x: x.isin(*STOP_WORDS, *[s.capitalize() for s in STOP_WORDS]))).cast("bigint").alias("n_stop_words"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
    ).select("*", F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines")).drop("l")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict, verdict and the names of the rules that a document breaks."""
    m = measures(docs, id_col, text_col)
    broken = []
    for r in rules:
        over, under = r.ratio.split(" / ")
        ratio = F.col(over) / F.greatest(F.col(under), F.lit(1)).cast("double")
        broken.append(F.when(~ratio.between(r.least, r.most), F.lit(r.name)))
    m = m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    m = m.withColumn("broken", F.array_compact(F.array(*broken)))
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    stop = ", ".join(f"'{x}', '{x.capitalize()}'" for x in STOP_WORDS)
    checks = " AND ".join(
        f"({a} / greatest({b}, 1)::DOUBLE) BETWEEN {r.least} AND {r.most}" for r in RULES for a, b in [r.ratio.split(" / ")]
    )
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, t, w, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM d),
e AS (SELECT r, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM g),
q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM e) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM q, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT g.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM g JOIN l USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {checks} AS kept FROM b
"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": _oracle()}
