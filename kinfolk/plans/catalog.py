"""Queries by name, with the SQL that gives the same rows.

The faces are the rows of ``embeddings``; the columns that a detector would add follow from ``vec_id`` by
the expressions of ``face_table``. IDs in comments are those of the survey.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.functions import geometry, paths
from kinfolk.functions.codec import decode_floats, encode_floats
from kinfolk.functions.scratch import materialize
from kinfolk.functions.vectors import dot, normalise, normalise_clipped
from kinfolk.operators.components import components
from kinfolk.operators.persons import best_thumbnails, multi_person_photos, person_photos, person_ranks, persons
from kinfolk.operators.similarity import similar_pairs
from kinfolk.plans import report as R
from kinfolk.plans.run import number_faces
from kinfolk.sinks import manifest
from kinfolk.sources.extractions import parse_extractions

THRESHOLD = 0.4
SWEEP = (0.2, 0.3, 0.4, 0.5, 0.6)

FACE_COLUMNS = """vec_id AS face_id,
  concat('/photos/d', cast(vec_id % 2 AS {text}), '/img_', cast(vec_id % 5 AS {text}), '.jpg') AS file_path,
  ((vec_id * 37) % 11) / {ten} AS det_score,
  CASE WHEN vec_id % 13 = 0 THEN '' ELSE concat('thumb_', cast(vec_id AS {text}), '.jpg') END AS thumbnail,
  ((vec_id * 7) % 1600) - 20.5{d} AS x1, ((vec_id * 11) % 900) - 10.25{d} AS y1,
  640 + (vec_id % 5) * 640 AS img_w, 480 + (vec_id % 3) * 720 AS img_h,
  CASE WHEN vec_id % 50 = 49 THEN concat('cannot read image: img_', cast(vec_id AS {text})) ELSE '' END AS error"""


def face_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    listed = FACE_COLUMNS.format(text="string", ten="10.0D", d="D")
    return spark.sql(f"SELECT {listed}, embedding FROM {{rows}}", rows=rows)


def _edges(f: DataFrame, t: float = THRESHOLD) -> DataFrame:
    return similar_pairs(f, t)


def _components(f: DataFrame) -> DataFrame:
    return materialize(components(f, _edges(f)))  # read by several parts of most queries


def normalize_vectors(f: DataFrame) -> DataFrame:  # MAP7, MAP8
    f = f.select("face_id", normalise(F.col("embedding")).alias("u"), normalise_clipped(F.col("embedding")).alias("c"))
    u, c = F.col("u"), F.col("c")
    return f.select("face_id", F.round(u[0], 6).alias("first"), F.round(F.sqrt(dot(u, u)), 6).alias("norm"), F.round(c[1], 6).alias("second"))


def similarity_pairs(f: DataFrame) -> DataFrame:  # JOIN1
    return _edges(f).select("src", "dst", F.round("sim", 6).alias("sim"))


def threshold_sweep(f: DataFrame) -> DataFrame:  # JOIN1, S1
    levels = F.explode(F.array(*[F.lit(t) for t in SWEEP]))
    low = _edges(f, min(SWEEP)).withColumn("threshold", levels).where("sim >= threshold")
    return low.groupBy("threshold").agg(F.count("*").alias("edges"))


def face_components(f: DataFrame) -> DataFrame:  # GR1-GR5
    return _components(f)


def degrees(f: DataFrame) -> DataFrame:
    e = _edges(f)
    return e.select(F.explode(F.array("src", "dst")).alias("face_id")).groupBy("face_id").agg(F.count("*").alias("degree"))


def persons_ranked(f: DataFrame) -> DataFrame:  # AGG1, AGG2, SORT1, RANK1
    return person_ranks(_components(f))


def photos_of_persons(f: DataFrame) -> DataFrame:  # AGG3, AGG4, SET1
    return person_photos(_components(f).join(f, "face_id"))


def thumbnails_of_persons(f: DataFrame) -> DataFrame:  # AGG5
    return best_thumbnails(_components(f).join(f, "face_id"))


def person_report(f: DataFrame) -> DataFrame:  # D9
    return persons(f, _components(f)).select("id", "photo_count", "face_count", "thumbnail", F.array_join("photos", "|").alias("photos"))


def photos_with_many(f: DataFrame) -> DataFrame:  # S7
    return multi_person_photos(f, _components(f))


def link_manifest(f: DataFrame) -> DataFrame:  # SNK1-SNK3
    comps = _components(f)
    return manifest(persons(f, comps), person_photos(comps.join(f, "face_id")))


def _images(f: DataFrame) -> DataFrame:
    return f.select(F.concat(F.lit("img_"), F.col("face_id").cast("string")).alias("path"), "error")


def _errors(f: DataFrame) -> DataFrame:
    return _images(f).where("error <> ''")


def run_totals(f: DataFrame) -> DataFrame:  # AGG6, S14
    fine = f.where("error = ''")
    return R.totals(_images(f), fine, person_ranks(_components(fine)), _errors(f))


def file_errors(f: DataFrame) -> DataFrame:  # MAP6, AGG7, SORT3, Q-UI4
    return R.error_list(_errors(f))


def report_stats(f: DataFrame) -> DataFrame:  # Q-UI1
    at = datetime(2026, 1, 1)
    people = person_ranks(_components(f))
    report = R.build_report(_images(f), f, people, _errors(f), started_at=at, finished_at=at, input_dir="in", output_dir="out", threshold=THRESHOLD)
    return R.stats(report)


def report_cards(f: DataFrame) -> DataFrame:  # Q-UI2
    return R.person_cards(persons(f, _components(f)))


def report_detail(f: DataFrame) -> DataFrame:  # Q-UI3
    return R.person_detail(persons(f, _components(f)), 0).select(F.col("photo_index").cast("bigint").alias("photo_index"), "photo")


def image_ext_filter(f: DataFrame) -> DataFrame:  # SRC2, SORT2
    names = F.array(*[F.lit(x) for x in ("a.JPG", "b.jpeg", "c.PNG", "d.gif", "e", ".jpg", "f.tar.jpg")])
    p = f.select("face_id", F.explode(names).alias("name"))
    p = p.select(F.concat(F.lit("/p"), F.col("face_id").cast("string"), F.lit("/"), F.col("name")).alias("path"))
    return p.where(paths.is_image(F.col("path"))).select("path", paths.extension(F.col("path")).alias("extension"))


def thumb_geometry(f: DataFrame) -> DataFrame:  # SRC5, MAP9
    w, h = geometry.scaled_size(F.col("img_w"), F.col("img_h"), 1920)
    box = geometry.crop_box(F.col("x1"), F.col("y1"), F.col("x1") + 100, F.col("y1") + 80, F.col("w"), F.col("h"))
    b = f.select("face_id", "x1", "y1", w.alias("w"), h.alias("h")).select("face_id", "w", "h", box.alias("b"))
    return b.select(
        F.col("face_id").alias("face_id"), *[F.col(c).cast("bigint").alias(c) for c in ("w", "h")],
        *[F.col(f"b.{c}").cast("bigint").alias(c) for c in ("left", "top", "right", "bottom")], F.col("b.empty").alias("empty"),
    )


def thumb_names(f: DataFrame) -> DataFrame:  # MAP10, MAP11
    return f.select(
        "face_id", paths.thumbnail_name(F.col("file_path"), F.col("face_id") % 3).alias("name"),
        paths.unique_thumbnail_name(F.col("file_path"), F.col("face_id") % 3).alias("unique_name"),
        paths.photo_reference(F.col("face_id"), F.col("file_path")).alias("reference"),
    )


def decode_embeddings(f: DataFrame) -> DataFrame:  # MAP1-MAP3
    back = decode_floats(encode_floats(F.col("embedding")))
    return f.select("face_id", F.size(back).cast("bigint").alias("n"), F.transform(back, lambda x: F.round(x, 6)).alias("v")).select("face_id", "n", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"))


def parse_records(f: DataFrame) -> DataFrame:  # SRC6, MAP1, MAP4-MAP6, S12, S13, SORT2
    face = F.struct(F.array(F.col("x1"), F.col("y1")).alias("bbox"), encode_floats(F.col("embedding")).alias("embedding"), "det_score", "thumbnail")
    line = F.when(F.col("error") != "", F.to_json(F.struct(F.col("file_path").alias("file"), "error"))).otherwise(
        F.to_json(F.struct(F.concat("file_path", F.lit("."), F.col("face_id").cast("string")).alias("file"), F.array(face, face).alias("faces")))
    )
    line = F.when(F.col("face_id") % 17 == 3, F.lit("warn: not a record")).otherwise(line)
    got = parse_extractions(f.select(line.alias("value")))
    faces = number_faces(got.faces.select("file_path", "face_idx", "bbox", "det_score", "thumbnail"))
    return faces.select("face_id", "file_path", F.col("face_idx").cast("bigint").alias("face_idx"), F.col("bbox")[1].alias("y1"), F.col("bbox")[3].alias("y2"), "det_score", "thumbnail")


def _on_faces(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(face_table(spark, sf_dir))

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: _on_faces(q)
    for q in (
        normalize_vectors, similarity_pairs, threshold_sweep, face_components, degrees, persons_ranked,
        photos_of_persons, thumbnails_of_persons, person_report, photos_with_many, link_manifest, run_totals, file_errors,
        report_stats, report_cards, report_detail, image_ext_filter, thumb_geometry, thumb_names, decode_embeddings, parse_records,
    )
}

_F = f"f AS (SELECT {FACE_COLUMNS.format(text='varchar', ten='10.0::double', d='::double')}, embedding::DOUBLE[] AS e FROM embeddings)"
_E = f"""e AS (SELECT a.face_id AS src, b.face_id AS dst, list_cosine_similarity(a.e, b.e) AS sim FROM f a JOIN f b ON a.face_id < b.face_id
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD})"""
_C = f"""{_F}, {_E}, u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
 r(id, lbl) AS (SELECT face_id, face_id FROM f UNION SELECT u.src, r.lbl FROM r JOIN u ON r.id = u.dst WHERE r.lbl < u.src),
 c AS (SELECT id AS face_id, min(lbl) AS component_id FROM r GROUP BY 1),
 k AS (SELECT component_id, count(*) AS face_count FROM c GROUP BY 1),
 p AS (SELECT row_number() OVER (ORDER BY face_count DESC, component_id)::BIGINT AS id, component_id, face_count FROM k),
 s AS (SELECT component_id, file_path, min(face_id) AS first_seen FROM c JOIN f USING (face_id) GROUP BY 1, 2),
 b AS (SELECT component_id, thumbnail FROM (SELECT component_id, thumbnail, row_number() OVER (PARTITION BY component_id ORDER BY det_score DESC, face_id) AS n
   FROM c JOIN f USING (face_id) WHERE thumbnail <> '' AND det_score > 0) WHERE n = 1),
 d AS (SELECT p.id, count(*) AS photo_count, p.face_count, coalesce(any_value(b.thumbnail), '') AS thumbnail,
   string_agg('Person_' || p.id || '/' || string_split(file_path, '/')[-1], '|' ORDER BY first_seen) AS photos
   FROM p JOIN s USING (component_id) LEFT JOIN b USING (component_id) GROUP BY p.id, p.face_count)"""
_W = f"WITH RECURSIVE {_C}"

ORACLES: dict[str, str] = {
    "normalize_vectors": f"""WITH {_F}, g AS (SELECT face_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM f)
SELECT face_id, round(e[1] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS first,
  round(sqrt(list_sum(list_transform(e, lambda x: (x / CASE WHEN n = 0 THEN 1 ELSE n END) ** 2))), 6) AS norm, round(e[2] / greatest(n, 1e-10), 6) AS second FROM g""",
    "similarity_pairs": f"WITH {_F}, {_E} SELECT src, dst, round(sim, 6) AS sim FROM e",
    "threshold_sweep": f"""WITH {_F}, x AS (SELECT list_cosine_similarity(a.e, b.e) AS sim FROM f a JOIN f b ON a.face_id < b.face_id)
SELECT t.threshold, count(*) AS edges FROM x JOIN (VALUES {', '.join(f'({t}::DOUBLE)' for t in SWEEP)}) t(threshold) ON sim >= threshold GROUP BY 1""",
    "face_components": f"{_W} SELECT face_id, component_id FROM c",
    "degrees": f"WITH {_F}, {_E} SELECT unnest([src, dst]) AS face_id, count(*) AS degree FROM e GROUP BY 1",
    "persons_ranked": f"{_W} SELECT id, component_id, face_count FROM p",
    "photos_of_persons": f"{_W} SELECT component_id, file_path, first_seen FROM s",
    "thumbnails_of_persons": f"{_W} SELECT component_id, thumbnail FROM b",
    "person_report": f"{_W} SELECT id, photo_count, face_count, thumbnail, photos FROM d",
    "photos_with_many": f"{_W} SELECT file_path, count(DISTINCT component_id) AS persons FROM s GROUP BY 1 HAVING count(DISTINCT component_id) > 1",
    "link_manifest": f"""{_W}, m AS (SELECT p.id AS person_id, file_path, string_split(file_path, '/')[-1] AS name FROM p JOIN s USING (component_id))
SELECT person_id, file_path AS photo_path, CASE WHEN count(*) OVER (PARTITION BY person_id, lower(name)) > 1 OR lower(name) = 'thumb.jpg'
  THEN substr(sha256(file_path), 1, 12) || '_' || name ELSE name END AS link_name FROM m""",
    "run_totals": f"""WITH RECURSIVE {_F.replace('FROM embeddings', 'FROM embeddings WHERE vec_id % 50 <> 49')}{_C[len(_F):]}
SELECT (SELECT count(*) FROM embeddings) AS total_images, (SELECT count(*) FROM f) AS total_faces, (SELECT count(*) FROM p) AS total_persons,
  (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 49) AS errors""",
    "file_errors": f"WITH {_F} SELECT row_number() OVER (ORDER BY 'img_' || face_id)::BIGINT AS number, 'img_' || face_id AS path, error FROM f WHERE error <> ''",
    "report_stats": f"""{_W} SELECT (SELECT count(*) FROM f) AS total_images, (SELECT count(*) FROM f) AS total_faces, (SELECT count(*) FROM p) AS total_persons,
  (SELECT count(*) FROM f WHERE error <> '') AS errors, '0s' AS duration, 'CPU' AS mode""",
    "report_cards": f"{_W} SELECT id - 1 AS position, 'Person ' || id AS name, thumbnail, photo_count, face_count, '' AS description FROM d",
    "report_detail": f"""{_W} SELECT (row_number() OVER (ORDER BY first_seen) - 1)::BIGINT AS photo_index, 'Person_1/' || string_split(file_path, '/')[-1] AS photo
  FROM p JOIN s USING (component_id) WHERE p.id = 1""",
    "image_ext_filter": r"""SELECT * FROM (SELECT '/p' || vec_id || '/' || n AS path, regexp_extract(lower(n), '(\.[^./]*)$', 1) AS extension
  FROM embeddings, unnest(['a.JPG', 'b.jpeg', 'c.PNG', 'd.gif', 'e', '.jpg', 'f.tar.jpg']) t(n)) WHERE extension IN ('.jpg', '.jpeg', '.png')""",
    "thumb_geometry": f"""WITH {_F}, g AS (SELECT face_id, trunc(x1)::BIGINT AS a, trunc(y1)::BIGINT AS b, trunc(x1 + 100)::BIGINT AS c, trunc(y1 + 80)::BIGINT AS d,
  CASE WHEN greatest(img_w, img_h) <= 1920 THEN img_w ELSE trunc(img_w * (1920.0::DOUBLE / greatest(img_w, img_h))) END::BIGINT AS w,
  CASE WHEN greatest(img_w, img_h) <= 1920 THEN img_h ELSE trunc(img_h * (1920.0::DOUBLE / greatest(img_w, img_h))) END::BIGINT AS h FROM f),
 k AS (SELECT face_id, w, h, greatest(0, a - trunc((c - a) * 0.25::DOUBLE)::BIGINT) AS "left", greatest(0, b - trunc((d - b) * 0.25::DOUBLE)::BIGINT) AS top,
  least(w, c + trunc((c - a) * 0.25::DOUBLE)::BIGINT) AS "right", least(h, d + trunc((d - b) * 0.25::DOUBLE)::BIGINT) AS bottom FROM g)
SELECT *, "right" <= "left" OR bottom <= top AS empty FROM k""",
    "thumb_names": f"""WITH {_F} SELECT face_id, 'img_' || face_id % 5 || '_face_' || face_id % 3 || '.jpg' AS name,
  'img_' || face_id % 5 || '_' || substr(sha256(file_path), 1, 12) || '_face_' || face_id % 3 || '.jpg' AS unique_name, 'Person_' || face_id || '/img_' || face_id % 5 || '.jpg' AS reference FROM f""",
    "decode_embeddings": f"WITH {_F} SELECT face_id, len(e)::BIGINT AS n, round(e[1], 6) AS first, round(e[2], 6) AS second FROM f",
    "parse_records": f"""WITH {_F}, g AS (SELECT file_path || '.' || face_id AS file_path, y1, det_score, thumbnail FROM f WHERE error = '' AND face_id % 17 <> 3)
SELECT row_number() OVER (ORDER BY string_split(file_path, '/'), face_idx)::BIGINT AS face_id, file_path, face_idx::BIGINT AS face_idx, y1, 0.0::DOUBLE AS y2, det_score, thumbnail
  FROM g, (VALUES (0), (1)) v(face_idx)""",
}
