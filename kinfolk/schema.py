"""Record types. ``face_id`` and ``face_idx`` give faces an identity and a place within their image."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _d, _l = T.StringType(), T.DoubleType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


IMAGES = _struct(path=_s)
DETECTION = _struct(bbox=T.ArrayType(_d), embedding=T.ArrayType(_d), det_score=_d, thumbnail=_s)
EXTRACTION = _struct(file=_s, faces=T.ArrayType(DETECTION), error=_s)
FACES = _struct(face_id=_l, file_path=_s, face_idx=T.IntegerType(), bbox=T.ArrayType(_d), embedding=T.ArrayType(_d), det_score=_d, thumbnail=_s)
FILE_ERRORS = _struct(path=_s, error=_s)
EDGES = _struct(src=_l, dst=_l, sim=_d)
COMPONENTS = _struct(face_id=_l, component_id=_l)
PERSONS = _struct(id=_l, photo_count=_l, face_count=_l, thumbnail=_s, photos=T.ArrayType(_s))
PERSON_REPORT = _struct(id=_l, photo_count=_l, face_count=_l, thumbnail=_s, description=_s, photos=T.ArrayType(_s))
REPORT = _struct(
    started_at=T.TimestampType(), finished_at=T.TimestampType(), duration=_s, input_dir=_s, output_dir=_s,
    total_images=_l, total_faces=_l, total_persons=_l, errors=_l, file_errors=T.MapType(_s, _s),
    threshold=_d, gpu=T.BooleanType(), persons=T.ArrayType(PERSON_REPORT),
)
