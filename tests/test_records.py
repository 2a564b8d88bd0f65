import base64
import json
import os
import signal
import struct
import threading
from datetime import timedelta
from urllib import error, request

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolk import schema, sinks
from kinfolk.functions import geometry, paths
from kinfolk.functions.codec import decode_floats, encode_floats
from kinfolk.functions.duration import duration_text
from kinfolk.functions.scratch import scratch_dir
from kinfolk.operators.describe import describe
from kinfolk.operators.extract import Stages, extract, faces_and_errors, staged
from kinfolk.plans import detect
from kinfolk.plans import report as R
from kinfolk.plans.run import main, run_images, run_records
from kinfolk.plans.serve import serve, start
from kinfolk.sources.extractions import parse_extractions, read_documents, read_extractions
from kinfolk.sources.images import one_image, read_images, read_listed, read_path_list, scan_images
from kinfolk.sources.stored import load_report, load_settings
from tests.conftest import rows


def b64(*values):
    return base64.b64encode(struct.pack(f"<{len(values)}f", *values)).decode()


def line(**k):
    return json.dumps(k)


def parse(spark, lines, **k):
    return parse_extractions(spark.createDataFrame([(x,) for x in lines], "value string"), **k)


def test_base64(spark):
    d = spark.createDataFrame([("AACAPw==",), ("AACAPwAAAEA=",), ("AAC=",), ("!!@@",), ("",), (None,)], "s string")
    got = [r.v for r in d.select(decode_floats(F.col("s")).alias("v")).collect()]
    assert got == [[1.0], [1.0, 2.0], None, None, [], None]
    back = spark.createDataFrame([([1.5, -2.0],)], "v array<double>").select(decode_floats(encode_floats(F.col("v"))).alias("v"))
    assert back.first().v == [1.5, -2.0]


@pytest.mark.parametrize(
    ("embedding", "want"),
    [(b64(1, 2), [1.0, 2.0]), ([0.1, 2], [0.1, 2.0]), (None, []), ("[0.1]", "bad"), ("AAC=", "bad"), (["x"], "bad"), ([1, None], [1.0, 0.0]), ("missing", "bad")],
)
def test_kinds_of_embeddings(spark, embedding, want):
    face = {"bbox": [1, 2, 3, 4, 5], "embedding": embedding, "det_score": 0.5}
    if embedding == "missing":
        del face["embedding"]
    got = parse(spark, [line(file="a", faces=[face])])
    if want == "bad":
        assert got.faces.count() == 0 and got.skipped.count() == 1 and got.processed.count() == 0
        assert rows(parse(spark, [line(file="a", faces=[face])], on_bad_record="error").file_errors) == [("a", "json decode error")]
    else:
        f = got.faces.first()
        assert f.embedding == want and f.bbox == [1.0, 2.0, 3.0, 4.0] and f.thumbnail == ""


def test_noise_errors_and_empty_records(spark):
    ok = {"bbox": [1], "embedding": b64(1), "det_score": 0.9, "thumbnail": "t"}
    got = parse(spark, [line(file="a", faces=[ok, ok]), "warn: onnx", line(file="b", error="cannot read image: b", faces=[ok]), line(file="c", faces=[]), "7"])
    assert rows(got.faces.select("file_path", "face_idx")) == [("a", 0), ("a", 1)]
    assert rows(got.file_errors) == [("b", "cannot read image: b")]
    assert rows(got.skipped) == [("7",), ("warn: onnx",)]
    assert rows(got.processed) == [("a",), ("b",), ("c",)]
    assert got.faces.first().bbox == [1.0, 0.0, 0.0, 0.0]


def test_single_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(line(faces=[{"embedding": b64(1)}]))
    (tmp_path / "b.json").write_text("{broken")
    got = read_documents(spark, str(tmp_path))
    assert got.faces.count() == 1 and [r.error for r in got.file_errors.collect()] == ["json decode error"]


def test_scan(spark, tmp_path):
    for name in ("a.JPG", "a/b.jpeg", "a/c.gif", ".hid/d.png", "_u.jpg", ".jpg", "z"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    os.symlink(tmp_path / "a", tmp_path / "lnk")
    got = [r.path.removeprefix(str(tmp_path)) for r in scan_images(spark, str(tmp_path)).collect()]
    assert got == ["/.hid/d.png", "/.jpg", "/_u.jpg", "/a/b.jpeg", "/a.JPG"]
    with pytest.raises(NotADirectoryError):
        scan_images(spark, str(tmp_path / "z"))
    assert read_images(spark, str(tmp_path / "a")).count() == 1
    (tmp_path / "list.txt").write_text(" x.jpg \n\n y.png\n")
    assert rows(read_path_list(spark, str(tmp_path / "list.txt"))) == [("x.jpg",), ("y.png",)]


@pytest.mark.parametrize(("path", "stem", "ext"), [("/a/x.tar.JPG", "x.tar", ".jpg"), ("/a/.jpg", ".jpg", ".jpg"), ("/a.b/c", "c", "")])
def test_names(spark, path, stem, ext):
    d = spark.createDataFrame([(path,)], "p string")
    assert tuple(d.select(paths.stem(F.col("p")), paths.extension(F.col("p"))).first()) == (stem, ext)


def test_geometry(spark):
    d = spark.createDataFrame([(4000, 2000), (100, 50)], "w int, h int")
    assert rows(d.select(*geometry.scaled_size(F.col("w"), F.col("h"), 1920))) == [(100, 50), (1920, 960)]
    assert rows(d.select(*geometry.scaled_size(F.col("w"), F.col("h"), 0))) == [(100, 50), (4000, 2000)]
    box = geometry.crop_box(F.lit(-20.5), F.lit(10.9), F.lit(80.0), F.lit(90.0), F.lit(100), F.lit(95)).alias("b")
    assert tuple(spark.range(1).select(box).first().b) == (0, 0, 100, 95, False)


@pytest.mark.parametrize(
    ("seconds", "text"), [(252, "4m12s"), (0, "0s"), (0.0004, "0s"), (0.25, "250ms"), (1.5, "1.5s"), (3600.5, "1h0m0.5s"), (61.0006, "1m1.001s")]
)
def test_durations(seconds, text):
    assert duration_text(timedelta(seconds=seconds)) == text


class Detector:
    def __call__(self):
        def detect(batch):
            if any(b"boom" in c for _, c in batch):
                raise ValueError("boom")
            return ["cannot read image: " + p if c == b"" else [dict(bbox=[0.0] * 4, embedding=[1.0, 0.0], det_score=0.9, thumbnail="")] for p, c in batch]

        return detect


def test_detector_failures_are_per_image(spark):
    images = spark.createDataFrame([("a", b"1"), ("b", b""), ("c", b"boom")], "path string, content binary")
    faces, errors = faces_and_errors(extract(images, Detector()))
    assert rows(faces.select("file_path", "face_idx")) == [("a", 0)]
    assert rows(errors) == [("b", "cannot read image: b"), ("c", "extraction error: boom")]


def test_describe(spark):
    p = spark.createDataFrame([(1, 1, 1, "t1", []), (2, 1, 1, "", []), (3, 1, 1, "t3", [])], schema.PERSONS)
    t = spark.createDataFrame([("t1", b"one"), ("t3", b"bad")], "thumbnail string, content binary")

    def tell(image: bytes) -> str:
        if image == b"bad":
            raise ValueError("no")
        return image.decode()

    assert rows(describe(p, tell, t).select("id", "description")) == [(1, "one"), (2, ""), (3, "")]


def test_whole_run(spark, tmp_path, capsys):
    src, out = tmp_path / "in", tmp_path / "out"
    for name in ("a/x.jpg", "b/x.jpg", "c.jpg", "thumb.jpg"):
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_bytes(name.encode())
    face = lambda *v: {"bbox": [0, 0, 1, 1], "embedding": b64(*v), "det_score": 0.9, "thumbnail": ""}
    lines = [
        line(file=str(src / "a/x.jpg"), faces=[face(1, 0)]),
        line(file=str(src / "b/x.jpg"), faces=[face(1, 0.1), face(0, 1)]),
        line(file=str(src / "thumb.jpg"), faces=[face(1, 0)]),
        line(file=str(src / "c.jpg"), error="cannot read image: c"),
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    images = scan_images(spark, str(src))
    report = run_records(spark, images, str(tmp_path / "r.jsonl"), str(out), input_dir=str(src))
    stats = R.stats(report).first()
    assert (stats.total_images, stats.total_faces, stats.total_persons, stats.errors, stats.mode) == (4, 4, 2, 1, "CPU")
    links = sorted(os.listdir(out / "Person_1"))
    assert len(links) == 3 and all(os.path.islink(out / "Person_1" / n) for n in links)
    assert (src / "a/x.jpg").read_bytes() == b"a/x.jpg"
    saved = load_report(spark, str(out / sinks.REPORT_FILE))
    assert rows(R.error_list(R.saved_errors(saved))) == [(1, str(src / "c.jpg"), "cannot read image: c")]
    people = R.saved_persons(saved)
    assert R.person_cards(people).count() == 2 and R.person_detail(people, 0).count() == 3
    assert R.person_detail(people, 9).count() == 0
    (out / "keep.txt").write_text("mine")
    sinks.clean_output(str(out))
    assert sorted(os.listdir(out)) == ["keep.txt", "manifest", "processing.log"]
    empty = tmp_path / "none.jsonl"
    empty.write_text("")
    assert run_records(spark, images, str(empty), str(out)) is None
    assert main(["--output", str(out)]) == 2


def test_run_from_images(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for name, content in (("a.jpg", b"1"), ("b.JPG", b"2"), ("c.png", b"boom"), ("d.gif", b"3")):
        (src / name).write_bytes(content)
    report = run_images(spark, str(src), Detector(), str(out))
    r = report.first()
    assert (r.total_images, r.total_faces, r.total_persons, r.errors) == (3, 2, 1, 1)
    assert sorted(os.listdir(out / "Person_1")) == ["a.jpg", "b.JPG"]
    assert "images 3" in (out / "processing.log").read_text()
    server = start(str(out), 0)
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        get = lambda p: request.urlopen(at + p).read()
        assert b"Persons" in get("/") and json.loads(get("/api/report"))["total_faces"] == 2
        assert get("/output/Person_1/a.jpg") == b"1"
        for bad in ("/x", "/output/../in/a.jpg", "/output/none"):
            with pytest.raises(error.HTTPError):
                get(bad)
    finally:
        server.shutdown()


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"chat": {"endpoint": "http://x", "model": "m", "max_tokens": 0}}')
    assert load_settings(str(tmp_path / "c.json")).max_tokens == 200
    assert load_settings(str(tmp_path / "none.json")) is None
    (tmp_path / "d.json").write_text('{"other": {"x": 1}, "any_name": {"endpoint": "http://x", "model": "m", "max_tokens": 7}}')
    assert load_settings(str(tmp_path / "d.json")).max_tokens == 7 and load_settings(str(tmp_path / "d.json"), "other") is None
    (tmp_path / "e.json").write_text("[]")
    assert load_settings(str(tmp_path / "e.json")) is None


def test_a_run_copies_thumbnails_and_deletes_its_scratch(spark, tmp_path):
    out = tmp_path / "out"
    for n in (1, 2):
        (tmp_path / f"t{n}.jpg").write_bytes(b"%d" % n)
    face = lambda thumb, *v: {"bbox": [0, 0, 1, 1], "embedding": b64(*v), "det_score": 0.9, "thumbnail": thumb}
    thumbs = [str(tmp_path / "t1.jpg"), str(tmp_path / "t2.jpg"), str(tmp_path / "lost.jpg"), ""]
    lines = [line(file=f"/p/{i}.jpg", faces=[face(t, *[float(i == k) for k in range(4)])]) for i, t in enumerate(thumbs)]
    (tmp_path / "r.jsonl").write_text("\n".join([*lines, line(file="/p/e.jpg", error="bad"), line(file="/p/e.jpg", error="worse")]))
    images = spark.createDataFrame([(f"/p/{i}.jpg",) for i in range(5)], schema.IMAGES)
    before = set(os.listdir(scratch_dir(spark).removeprefix("file:")))
    report = run_records(spark, images, str(tmp_path / "r.jsonl"), str(out), describer=lambda image: f"person on {image.decode()}")
    assert set(os.listdir(scratch_dir(spark).removeprefix("file:"))) == before
    assert (report.first().errors, report.first().total_persons) == (2, 4)
    saved = json.loads((out / sinks.REPORT_FILE).read_text())
    assert [(p["thumbnail"], p.get("description")) for p in saved["persons"]] == [("Person_1/thumb.jpg", "person on 1"), ("Person_2/thumb.jpg", "person on 2"), ("", None), ("", None)]
    assert saved["file_errors"] == {"/p/e.jpg": "worse"} and list(saved)[-1] == "persons"
    assert (out / "Person_2/thumb.jpg").read_bytes() == b"2"
    assert json.dumps(saved, indent=2, ensure_ascii=False).strip() == (out / sinks.REPORT_FILE).read_text().strip()


def test_thumbnail_folder_starts_empty(tmp_path):
    at = sinks.reset_thumbnails(str(tmp_path))
    open(os.path.join(at, "x"), "w").close()
    assert os.listdir(sinks.reset_thumbnails(str(tmp_path))) == []


class Steps:
    """Images are texts; faces are their words, recognised together."""

    calls: list = []

    def __init__(self, together=True):
        self.together = together

    def __call__(self):
        def recognise(aligned):
            Steps.calls.append(len(aligned))
            return np.array([[len(w), 0.0] if w != "nil" else [0.0, 0.0] for w in aligned])

        return Stages(
            load=lambda path, content: None if content is None else content.decode().split(), detect=lambda words: [([0, 0, 1, 1], 0.5, w) for w in words],
            recognise=recognise if self.together else None, embed=lambda w: [0.0, len(w)], thumbnail=lambda image, box, path, i: f"{path}_{i}", providers=("cpu",),
        )


def test_faces_of_several_images_are_recognised_at_once():
    images = [("a", b"x yy"), ("b", b""), ("c", None), ("d", b"z nil w"), ("e", b"q"), ("f", b"r s t u")]
    for together, calls in ((True, [5, 5]), (False, [])):
        Steps.calls.clear()
        got = staged(Steps(together), 4)()(images)
        assert Steps.calls == calls
        assert got[1] == [] and got[2] == "cannot read image: c"
        assert [[f["thumbnail"] for f in r] for r in (got[0], got[3], got[5])] == [["a_0", "a_1"], ["d_0", "d_1", "d_2"], [f"f_{i}" for i in range(4)]]
        assert got[0][1]["embedding"] == ([1.0, 0.0] if together else [0.0, 1.0])
    assert staged(Steps(), 4)()([("d", b"nil")])[0][0]["embedding"] == [0.0, 0.0]


def test_the_first_failure_may_end_a_run(spark):
    images = spark.createDataFrame([("a", b"1"), ("c", b"boom")], "path string, content binary")
    with pytest.raises(Exception, match="boom"):
        extract(images, Detector(), fail_fast=True).collect()


def test_listed_and_single_images(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"1")
    listed = one_image(spark, str(tmp_path / "a.jpg")).union(spark.createDataFrame([(str(tmp_path / "no.jpg"),)], schema.IMAGES))
    assert rows(read_listed(listed)) == [(str(tmp_path / "a.jpg"), bytearray(b"1")), (str(tmp_path / "no.jpg"), None)]
    report = run_images(spark, one_image(spark, str(tmp_path / "a.jpg")), Detector(), str(tmp_path / "out"))
    assert (report.first().total_images, report.first().total_faces) == (1, 1)


def with_settings(gpu, max_dim, thumb_dir=""):
    def each(batch):
        return ["cannot read image: " + p if c is None else [dict(bbox=[0.0] * 4, embedding=[max_dim, float(gpu)], det_score=0.5, thumbnail=thumb_dir)] for p, c in batch]

    return each


def without_thumbnails(gpu, max_dim):
    return with_settings(gpu, max_dim)


def test_a_detector_by_itself(spark, tmp_path, capsys, monkeypatch):
    image, listed, to = tmp_path / "a.jpg", tmp_path / "list", tmp_path / "records"
    image.write_bytes(b"1")
    listed.write_text(f" {image} \n\n{tmp_path / 'no.jpg'}\n")
    name = f"{__name__}:with_settings"
    assert detect.main(["--detector", name]) == 1
    assert json.loads(capsys.readouterr().out) == {"error": detect.USAGE, "faces": []}
    assert detect.main([str(image), "--detector", name, "--gpu", "--max-dim", "640", "--thumb-dir", str(tmp_path / "t")]) == 0
    record = json.loads(capsys.readouterr().out)
    face = record["faces"][0]
    assert record["file"] == str(image) and "error" not in record and (tmp_path / "t").is_dir()
    assert (face["embedding"], face["thumbnail"]) == (b64(640, 1), str(tmp_path / "t"))
    assert detect.main([str(image), "--list", str(listed), "--records", str(to), "--detector", f"{__name__}:without_thumbnails"]) == 0
    got = read_extractions(spark, str(to))
    assert rows(got.faces.select("file_path", "embedding")) == [(str(image), [0.0, 0.0])]
    assert rows(got.file_errors) == [(str(tmp_path / "no.jpg"), f"cannot read image: {tmp_path / 'no.jpg'}")]
    monkeypatch.setattr("sys.stdin", iter([f"{image}\n", " \n", f"{image}\n"]))
    assert detect.main(["--list", "-", "--detector", name]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2


def test_skipped_lines_are_cut_by_bytes(spark):
    got = parse(spark, ["é" * 150, "x" * 300]).skipped.collect()
    assert sorted(len(r.value.encode()) for r in got) == [200, 200]


def test_serving_ends_on_a_signal(tmp_path):
    threading.Timer(0.5, os.kill, (os.getpid(), signal.SIGTERM)).start()
    serve(str(tmp_path), 0)


def test_thumbnail_copy(tmp_path):
    (tmp_path / "t.jpg").write_bytes(b"x")
    assert sinks.copy_thumbnail(str(tmp_path / "t.jpg"), str(tmp_path / "o"), 3) == "Person_3/thumb.jpg"
    assert sinks.copy_thumbnail(str(tmp_path / "no.jpg"), str(tmp_path / "o"), 3) == ""
