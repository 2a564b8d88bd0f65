"""Secret scans with multipart credential linking (operator 9), in built-in functions only.

Base kinds are regular expressions. Spark returns matches but no positions, so a text is split by the
same expression: a match starts after the pieces and the matches before it, counted in code points.

The method adds what no single pattern can claim. A *weak* candidate, such as ``secret_access_part: x``
or ``user=x`` or a URL, is no finding alone. Within a scope (a block of lines, ended by an empty line)
access identifiers, secrets and endpoints are joined by interval: a weak candidate is reported only if
a candidate of a complementary part starts within ``REACH`` code points of its own start and in its scope. Candidates of
a part are sorted by start, so the join is one binary search for the first of them in the interval: k candidates cost k * log k.

Cases: null and empty texts have no spans; the SHA-256 is then that of the empty string; texts of any length are scanned whole.
Overlapping spans of different kinds all stay. Rows are judged one by one: repeated rows repeat; no rows give no rows. Extra columns,
whatever their names, stay in ``redact`` and are left out of ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.llm.common import table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")

# The parts of a credential and how a weak candidate of each is written.
PARTS = {
    "ident": r"""(?i:user(?:name)?|login|client_?id|access_?key_?id|account|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}""",
    "private": r"""(?i:pass|pwd|pass_?phrase|client_?secret|access_?key|private_?key|auth|credential)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""",
    "endpoint": r"""(?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?@%+=&-]{4,}""",
}
KINDS = (*BASE_KINDS, *PARTS)
REACH = 200
FOLD = 256
REDACTED = "[redacted]"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def find(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, rank of kind, match) of the leftmost non-overlapping matches in ``text``."""
    rank = KINDS.index(kind)
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def place(p: Column) -> Column:
        empty = F.array().cast("array<struct<s:bigint,k:int,e:bigint,m:string>>")

        def step(acc: Column, pair: Column) -> Column:
            s = acc["at"] + F.length(pair["gap"])
            e = s + F.length(pair["hit"])
            one = F.struct(s.alias("s"), F.lit(rank).alias("k"), e.alias("e"), pair["hit"].alias("m"))
            return F.struct(e.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

        def run(block: Column, at: Column) -> Column:
            return F.aggregate(block, F.struct(at.alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])

        # folds append to arrays, which copies them: blocks keep that in bounds for texts of very many matches
        def blocked(pairs: Column) -> Column:
            cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / FOLD).cast("int")), lambda i: F.slice(pairs, i * FOLD + 1, FOLD))
            return _let(cut, joined)

        def joined(blocks: Column) -> Column:
            long = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["gap"]) + F.length(x["hit"])))
            none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
            starts = F.aggregate(long, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(blocks, starts, run))

        gaps = F.slice(p["gaps"], 1, F.size(p["hits"]))
        return _let(F.zip_with(gaps, p["hits"], lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), blocked)

    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint,m:string>>")
    return F.when(text.rlike(pattern), _let(parts, place)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds; an assignment counts if its value has 6 characters or more."""
    assign = F.filter(find(text, ASSIGN, "assign"), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN_VALUE, 1)) >= 6)
    return F.concat(assign, find(text, ACCESS, "access"), find(text, HEX, "hex"))


def _scope_ends(text: Column) -> Column:
    """Positions (code points) of the empty lines that end scopes."""
    return F.transform(find(text, r"\n[\x20\t\r]*\n", "assign"), lambda x: x["e"])


#: The part that a kind stands for: 0 identifier, 1 secret, 2 endpoint.
ROLES = {"assign": 1, "access": 0, "hex": 1, "ident": 0, "private": 1, "endpoint": 2}


def _lower_bound(values: Column, least: Column) -> Column:
    """How many of the ascending ``values`` are below ``least``, by binary search."""
    none = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        below = F.get(values, mid) < least
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(acc["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))
    return F.aggregate(steps, none, halve, lambda acc: acc["lo"])


def linked_spans(text: Column, strong: Column) -> Column:
    """Weak candidates that have a complementary part in reach within their scope.

    ``strong`` are base spans: an access key counts as an identifier, an assignment or hex string as a secret. A weak
    candidate that overlaps a base span of its own role is that finding already and is left out.
    """
    weak = F.concat(*[find(text, p, k) for k, p in PARTS.items()])
    role = F.array(*[F.lit(ROLES[k]) for k in KINDS])

    def own(c: Column) -> Column:
        """Weak candidates without those that are base findings. Spans of one base kind do not overlap, so their ends are in order too."""

        def new(x: Column) -> Column:
            hit = F.lit(False)
            for k, kind in enumerate(BASE_KINDS):
                at = _lower_bound(c[f"e{k}"], x["s"] + 1)
                hit = hit | ((F.get(role, x["k"]) == ROLES[kind]) & F.coalesce(F.get(c[f"s{k}"], at) < x["e"], F.lit(False)))
            return ~hit

        return F.struct(F.filter(c["weak"], new).alias("weak"), c["ends"].alias("ends"))

    def starts(c: Column) -> Column:
        """The starts of all candidates of each role, ascending."""

        def of(r: int) -> Column:
            some = F.filter(F.concat(strong, c["weak"]), lambda x: F.get(role, x["k"]) == r)
            return F.array_sort(F.transform(some, lambda x: x["s"])).alias(f"r{r}")

        return F.struct(*[of(r) for r in range(3)], c["weak"].alias("weak"), c["ends"].alias("ends"))

    def link(c: Column) -> Column:
        def partner(x: Column, r: int) -> Column:
            scope = _lower_bound(c["ends"], x["s"] + 1)
            least = F.greatest(x["s"] - REACH, F.coalesce(F.get(c["ends"], scope - 1), F.lit(0).cast("bigint")))
            end = F.coalesce(F.get(c["ends"], scope), F.lit(1 << 62))
            first = F.get(c[f"r{r}"], _lower_bound(c[f"r{r}"], least))
            return F.coalesce((first <= x["s"] + REACH) & (first < end), F.lit(False))

        return F.filter(c["weak"], lambda x: F.when(F.get(role, x["k"]) == 1, partner(x, 0) | partner(x, 2)).otherwise(partner(x, 1)))

    by_kind = []
    for k in range(len(BASE_KINDS)):
        mine = F.array_sort(F.filter(strong, lambda x, k=k: x["k"] == k))
        by_kind += [F.transform(mine, lambda x: x["s"]).alias(f"s{k}"), F.transform(mine, lambda x: x["e"]).alias(f"e{k}")]
    packed = F.struct(weak.alias("weak"), _scope_ends(text).alias("ends"), *by_kind)
    found = _let(_let(_let(packed, own), starts), link)
    some = F.lit(False)
    for p in PARTS.values():
        some = some | text.rlike(p)
    return F.when(some, found).otherwise(F.array().cast("array<struct<s:bigint,k:int,e:bigint,m:string>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``, ``base`` and ``spans`` (all spans): arrays of (s, k, e, m) by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    d = d.withColumn("base", F.sort_array(base_spans(F.col("text"))))
    return d.withColumn("spans", F.sort_array(F.concat("base", linked_spans(F.col("text"), F.col("base")))))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op9_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return scan(docs).select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_digest(table(spark, sf_dir, "documents"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every span in their text replaced by a mark; a length column ``n_chars`` follows the text.

    Overlapping spans become one mark. A text without spans, null included, stays as it is.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumn("__base", base_spans(text))
    marked = marked.withColumn("__spans", F.sort_array(F.concat("__base", linked_spans(text, F.col("__base")))))

    def cut(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            piece = F.concat(F.substring(p["t"], acc["at"] + 1, x["s"] - acc["at"]), F.lit(REDACTED))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(p["spans"], start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(p["t"], acc["at"] + 1, F.length(p["t"]))))

    clean = _let(F.struct(text.alias("t"), F.col("__spans").alias("spans")), cut)
    out = marked.withColumn(text_col, F.when(F.size("__spans") > 0, clean).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _oracle() -> str:
    pats = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, **PARTS, "end": r"\n[\x20\t\r]*\n"}
    quoted = {k: p.replace("'", "''") for k, p in pats.items()}
    raw = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, unnest(string_split_regex(t, '{p}')) AS g, unnest(regexp_extract_all(t, '{p}')) AS m, "
        f"unnest(range(1, len(string_split_regex(t, '{p}')) + 1)) AS i FROM d WHERE regexp_matches(t, '{p}')"
        for i, p in enumerate(quoted.values())
    )
    value = ASSIGN_VALUE.replace("'", "''")
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    role = "[" + ", ".join(str(ROLES[k]) for k in KINDS) + "]"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({raw}),
pos AS (SELECT doc_id, k, m, (sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM raw WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)),
hit AS (SELECT doc_id, k, s, s + length(m) AS e, m FROM pos WHERE m IS NOT NULL AND (k <> 0 OR length(regexp_extract(m, '{value}', 1)) >= 6)),
base AS (SELECT * FROM hit WHERE k < 3),
ends AS (SELECT * FROM hit WHERE k = 6),
own AS (SELECT * FROM hit h WHERE k BETWEEN 3 AND 5 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND h.s < b.e AND b.s < h.e AND {role}[b.k + 1] = {role}[h.k + 1])),
part AS (SELECT a.*, {role}[k + 1] AS r, (SELECT count(*) FROM ends n WHERE n.doc_id = a.doc_id AND n.e <= a.s) AS c FROM (SELECT * FROM own UNION ALL SELECT * FROM base) a),
weak AS (SELECT * FROM part x WHERE k > 2 AND EXISTS (SELECT 1 FROM part y WHERE y.doc_id = x.doc_id AND y.c = x.c AND abs(y.s - x.s) <= {REACH}
  AND ((x.r <> 1 AND y.r = 1) OR (x.r = 1 AND y.r <> 1)))),
b AS (SELECT doc_id, string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS x, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h FROM base GROUP BY 1),
z AS (SELECT doc_id, string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS x FROM (SELECT doc_id, k, s, e FROM base UNION ALL SELECT doc_id, k, s, e FROM weak) GROUP BY 1)
SELECT doc_id, coalesce(b.a, 0)::BIGINT AS n_assign, coalesce(b.c, 0)::BIGINT AS n_access, coalesce(b.h, 0)::BIGINT AS n_hex,
  sha256(coalesce(b.x, '')) AS base_sha256, coalesce(z.x, '') AS spans FROM d LEFT JOIN b USING (doc_id) LEFT JOIN z USING (doc_id)
"""


QUERIES = {"op9_secret_scans": op9_secret_scans}
ORACLES = {"op9_secret_scans": _oracle()}
