import bz2
import io
import itertools
import json
import struct
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.plans import stages
from voxcohort.operators.records import MissingRows
from voxcohort.sources import archives, formats, sinks, stores, tabular, volumes
from voxcohort.streaming import incremental


def test_csv_with_and_without_mark(spark, tmp_path):
    for name, mark, end in (("a", "﻿", "\r\n"), ("b", "", "\n")):
        (tmp_path / f"{name}.csv").write_text(f"{mark}id,v{end}1,{end}2,x{end}", encoding="utf-8", newline="")
        rows = tabular.typed(tabular.table(spark, str(tmp_path / f"{name}.csv")), id="bigint").collect()
        assert [(r.id, r.v) for r in rows] == [(1, None), (2, "x")]
    (tmp_path / "c.tab").write_text("ID\ttype\n7\tHCC\n")
    assert tabular.table(spark, str(tmp_path / "c.tab"), sep="\t").first().type == "HCC"


def test_log_last_record_of_the_current_version(spark, tmp_path):
    lines = [{"p": "1", "v": "old", "x": 1}, {"p": "1", "v": "new", "x": 2}, {"p": "1", "v": "new", "x": 3}, {"p": "2", "v": "new", "error": "no"}]
    (tmp_path / "m.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    got = tabular.log(spark, str(tmp_path / "m.jsonl"), "p string, v string, x int, error string", ["p"], "new", "v").collect()
    assert [(r.p, r.x) for r in got] == [("1", 3)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/1_2_3_tumor_seg.nrrd", b"abc")
        z.writestr("e/1_2_3_tumor_seg.nrrd", b"later")
        z.writestr("d/none", b"")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        info = tarfile.TarInfo("x/other.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    c = archives.members(spark, str(tmp_path), with_data=True)
    assert {(r.basename, r.size) for r in c.collect()} == {("1_2_3_tumor_seg.nrrd", 3), ("1_2_3_tumor_seg.nrrd", 5), ("none", 0), ("other.txt", 2)}
    with pytest.raises(ValueError):
        archives.unique(c)
    m = archives.lesion_masks(c).collect()
    assert [(r.patient_id, r.phase, r.lesion, r.member) for r in m] == [("1", "2", "3", "d/1_2_3_tumor_seg.nrrd")]
    wanted = spark.createDataFrame([("none",), ("other.txt",), ("lost",)], "basename string")
    assert {r.basename for r in archives.missing(c, wanted).collect()} == {"none", "lost"}
    assert archives.members(spark, str(tmp_path / "b.tar"), ["other.txt"], True).first().data == b"hi"


def test_members_are_materialised(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.nii.gz", b"1")
        z.writestr("d/none.nii", b"")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        for name, data in (("./NIFTI/two.nii", b"22"), ("x/three.nii", b"333")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "four.nii").write_bytes(b"4444")
    (tmp_path / "empty.nii").write_bytes(b"")
    a, b = (f"file:{tmp_path}/{n}" for n in ("a.zip", "b.tar"))
    good = [("i1", "zip", None, a, "d/one.nii.gz"), ("i2", "tar", None, b, "./NIFTI/two.nii"), ("i3", "tar", None, b, "other/three.nii"), ("i4", "path", str(tmp_path / "four.nii"), None, None)]
    bad = [("j1", "zip", None, a, "d/none.nii"), ("j2", "zip", None, a, "two.nii"), ("j3", "path", str(tmp_path / "empty.nii"), None, None), ("j4", "path", str(tmp_path / "lost.nii"), None, None), ("j5", "rar", None, a, "x"), ("j6", "tar", None, b, "no.nii")]
    frame = lambda rows: spark.createDataFrame(rows, "name string, kind string, path string, archive string, member string")
    got = {r.name: bytes(r.data) for r in archives.materialised(frame(good)).collect()}
    assert got == {"i1": b"1", "i2": b"22", "i3": b"333", "i4": b"4444"}
    with pytest.raises(MissingRows):
        archives.materialised(frame(good + bad))
    rows = {r.name: r.problem for r in archives.materialised(frame(good + bad), strict=False).collect()}
    assert all(rows[g[0]] is None for g in good) and (rows["j1"], rows["j2"], rows["j3"], rows["j6"]) == ("empty", "missing", "empty", "missing") and rows["j4"] and "rar" in rows["j5"]


def test_wanted_members_must_be_there(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x", b"1")
        z.writestr("d/y", b"")
    c = archives.members(spark, str(tmp_path))
    wanted = lambda *n: spark.createDataFrame([(x,) for x in n], "basename string")
    assert [r.member for r in archives.complete(c, wanted("x", "x")).collect()] == ["d/x"]
    with pytest.raises(MissingRows, match="y, z"):
        archives.complete(c, wanted("z", "x", "y"))


def marked():
    v = np.zeros((4, 3, 5), np.int16)
    v[1, 2, 3], v[3, 0, 4] = 7, -2
    return v


@pytest.mark.parametrize("ending", [".nii.gz", ".nii", ".nrrd"])
def test_volumes(spark, tmp_path, ending):
    v = marked()
    data = formats.nrrd(v, [0.5, 0.75, 2.5], [1, 2, 3]) if ending == ".nrrd" else formats.nifti(v, [0.5, 0.75, 2.5], [1, 2, 3])
    (tmp_path / f"case1{ending}").write_bytes(formats.inflated(data) if ending == ".nii" else data)
    h = volumes.headers(spark, f"{tmp_path}/*").first()
    assert (h.case_id, h["size"], h.spacing_mm, h.origin_mm, h.dtype, h.channels) == ("case1", [5, 3, 4], [0.5, 0.75, 2.5], [1, 2, 3], "i2", 1)
    assert h.direction == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert [tuple(r) for r in volumes.voxels(spark, str(tmp_path)).collect()] == [("case1", 1, 2, 3, 7.0)]
    assert [tuple(r) for r in volumes.voxels(spark, str(tmp_path), label=-2).collect()] == [("case1", 3, 0, 4, -2.0)]
    assert volumes.voxels(spark, str(tmp_path), foreground=False).count() == 60
    g = volumes.headers(spark, str(tmp_path))
    assert volumes.same_grid(g, g).first().same
    listed = stores.listing(spark, str(tmp_path)).first()
    assert listed.case_id == "case1" and listed.length == (tmp_path / f"case1{ending}").stat().st_size


def test_volumes_are_turned_to_lps():
    rng = np.random.default_rng(2)
    base = rng.integers(-9, 9, (2, 3, 4)).astype(np.int16)  # [z, y, x]
    at = lambda h, i: np.array(h["origin_mm"]) + np.array(h["direction"]).reshape(3, 3) @ (np.array(i) * h["spacing_mm"])
    for axes in itertools.permutations(range(3)):
        for signs in itertools.product((1, -1), repeat=3):
            direction = np.zeros((3, 3))
            for column, (row, sign) in enumerate(zip(axes, signs, strict=True)):
                direction[row, column] = sign
            for make in (formats.nifti, formats.nrrd):
                h, a = formats.volume(make(base, [1.0, 2.0, 3.0], [10, 20, 30], direction.ravel().tolist()))
                o, b = formats.oriented(h, a)
                assert np.allclose(np.array(o["direction"]).reshape(3, 3), np.eye(3)) and list(b.shape) == o["size"][::-1]
                world = {tuple(np.round(at(h, (x, y, z)), 5)): a[z, y, x] for z in range(2) for y in range(3) for x in range(4)}
                assert world == {tuple(np.round(at(o, i), 5)): b[i[::-1]] for i in itertools.product(*map(range, o["size"]))}


def test_oblique_volumes_keep_their_directions():
    c, s = np.cos(0.3), np.sin(0.3)
    direction = [c, -s, 0, s, c, 0, 0, 0, 1]
    h, _ = formats.volume(formats.nifti(marked(), [0.5, 0.75, 2.5], [1, 2, 3], direction))
    o, _ = formats.oriented(h, marked())
    assert np.allclose(o["direction"], direction, atol=1e-6) and np.allclose(o["spacing_mm"], [0.5, 0.75, 2.5])
    turned = bytearray(formats.inflated(formats.nifti(marked(), [1, 1, 1])))
    struct.pack_into("<2h", turned, 252, 1, 0)
    struct.pack_into("<6f", turned, 256, 0, 0, 1, 5, 6, 7)  # a half turn about z, in RAS
    q = formats.nifti_header(bytes(turned))
    assert np.allclose(q["direction"], [1, 0, 0, 0, 1, 0, 0, 0, 1]) and q["origin_mm"] == [-5, -6, 7]


def test_channels_collapse():
    v = marked()
    same, other = np.stack([v, v, v], axis=-1), np.stack([v, v + 3, v], axis=-1)
    a, fix = formats.collapsed(formats.volume(formats.nrrd(same, [1, 1, 1]))[1])
    assert (a == v).all() and fix == "identical_components_collapsed_to_first"
    a, fix = formats.collapsed(formats.volume(formats.nrrd(other, [1, 1, 1]))[1])
    assert np.allclose(a, v + 1) and fix == "nonidentical_rgb_components_averaged_to_greyscale"
    colour = bytearray(formats.inflated(formats.nifti(np.zeros((1, 2, 2), np.uint8), [1, 1, 1]))[:352])
    struct.pack_into("<2h", colour, 70, 128, 24)
    h, a = formats.volume(bytes(colour) + bytes(range(12)))
    assert a.shape == (1, 2, 2, 3) and a[0, 1, 0].tolist() == [6, 7, 8]
    planes = bytearray(formats.inflated(formats.nifti(np.zeros((1, 2, 2), np.uint8), [1, 1, 1]))[:352])
    struct.pack_into("<8h", planes, 40, 5, 2, 2, 1, 1, 3, 1, 1)
    h, a = formats.volume(bytes(planes) + bytes(range(12)))
    assert h["channels"] == 3 and a[0, 1, 0].tolist() == [2, 6, 10]
    struct.pack_into("<8h", planes, 40, 4, 2, 2, 1, 3, 1, 1, 1)
    with pytest.raises(ValueError, match="three dimensions"):
        formats.volume(bytes(planes) + bytes(range(12)))


def test_nrrd_variants():
    v = marked()
    head = "NRRD0004\n# a note\ntype: {}\ndimension: 3\nsizes: 5 3 4\nspacings: 0.5 0.75 2.5\nencoding: {}\nendian: {}\nkey:=value\n\n"
    for kind, encoding, endian, body in (("short", "raw", "big", v.astype(">i2").tobytes()), ("double", "ascii", "little", " ".join(map(str, v.ravel())).encode()), ("int16", "bzip2", "little", bz2.compress(v.tobytes()))):
        h, a = formats.volume(head.format(kind, encoding, endian).encode() + body)
        assert (a == v).all() and h["spacing_mm"] == [0.5, 0.75, 2.5] and h["direction"][0] == 1
    for broken in (b"NRRD0004\ntype: short", b"neither", b""):
        with pytest.raises(ValueError, match="header"):
            formats.header(broken)


def test_headers_read_little(spark, tmp_path):
    noise = np.random.default_rng(1).integers(-999, 999, (60, 64, 64)).astype(np.int16)
    (tmp_path / "big.nii.gz").write_bytes(formats.nifti(noise, [1, 1, 1])[:5000])  # the voxels are cut off: only a header is needed
    assert volumes.headers(spark, str(tmp_path / "*.gz")).first()["size"] == [64, 64, 60]


def test_volumes_are_written(spark, tmp_path):
    rows = [("a", 1, 2, 3, 200.0), ("a", 0, 0, 0, 300.4), ("b", 0, 0, 0, 1.0), ("lost", 0, 0, 0, 1.0)]
    v = spark.createDataFrame(rows, "case_id string, z int, y int, x int, value double")
    direction = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    g = spark.createDataFrame([(c, [5, 3, 4], [0.5, 0.75, 2.5], [1.0, 2.0, 3.0], direction) for c in ("a", "b", "c")], "case_id string, size array<int>, spacing_mm array<double>, origin_mm array<double>, direction array<double>")
    for _ in range(2):  # again, over what is there
        done = {r.case_id: r.voxels for r in volumes.write(v, g, f"file:{tmp_path}/out").collect()}
    assert done == {"a": 2, "b": 1, "c": 0} and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.nii.gz", "b.nii.gz", "c.nii.gz"]
    back = {tuple(r) for r in volumes.voxels(spark, f"{tmp_path}/out").collect()}
    assert back == {("a", 1, 2, 3, 200.0), ("a", 0, 0, 0, 255.0), ("b", 0, 0, 0, 1.0)}
    assert volumes.same_grid(volumes.headers(spark, f"{tmp_path}/out"), g).where("same").count() == 3


def test_phase_pairs(spark):
    kind = "case_id string, phase string, path string, size array<int>"
    images = spark.createDataFrame([("a", "NC", "i1", [2, 2, 2]), ("a", "AP", "i2", [2, 2, 3])], kind)
    masks = spark.createDataFrame([("a", "NC", "m1", [2, 2, 2]), ("a", "AP", "m2", [2, 2, 3])], kind)
    assert {(r.path, r.mask_path) for r in volumes.phase_pairs(images, masks).collect()} == {("i1", "m1"), ("i2", "m2")}
    for wrong in (masks.where("phase = 'NC'"), spark.createDataFrame([("a", "NC", "m1", [2, 2, 2]), ("a", "AP", "m2", [2, 3, 2])], kind)):
        with pytest.raises(MissingRows):
            volumes.phase_pairs(images, wrong)


def test_geometry_table(spark, tmp_path):
    head = "patient_id,phase,spacing_x_mm,spacing_y_mm,spacing_z_mm,k_axis_flip,vertebra_pairs,spacing_z_source,totalsegmentator_liver_native_file"
    (tmp_path / "g.csv").write_text(f"\ufeff{head}\n1,NC,0.78,0.78,2.5,1,3,x,fall/back.nii.gz\n1,AP,0.78,0.78,1.5,,,y,\n2,NC,0.78,0.78,1.5,0,1,y,/abs/m.nii.gz\n", encoding="utf-8")
    got = {(r.patient_id, r.phase): r for r in tabular.geometry(spark, str(tmp_path / "g.csv")).collect()}
    assert got["1", "NC"].spacing_mm == [0.78, 0.78, 2.5] and got["1", "NC"].k_axis_flip and got["1", "NC"].liver_fallback_file == f"{tmp_path}/fall/back.nii.gz"
    assert not got["1", "AP"].k_axis_flip and got["1", "AP"].vertebra_pairs == 0 and got["1", "AP"].liver_fallback_file is None and got["2", "NC"].liver_fallback_file == "/abs/m.nii.gz"
    (tmp_path / "h.csv").write_text(f"{head}\n1,NC,1,1,1,,,,\n1,NC,1,1,1,,,,\n")
    with pytest.raises(ValueError, match="more than one row"):
        tabular.geometry(spark, str(tmp_path / "h.csv"))
    paths = spark.createDataFrame([("/o/manifests/p/a.nii.gz",), ("/x/b.nii.gz",), (None,), ("",)], "p string")
    assert [r.q for r in paths.select(tabular.portable(F.col("p"), "/o/manifests").alias("q")).collect()] == ["p/a.nii.gz", "plc_geometry/liver_fallback/b.nii.gz", "", ""]


def test_case_folders(spark, tmp_path):
    for name in ("b", "a", "none"):
        (tmp_path / name).mkdir()
        if name != "none":
            (tmp_path / name / "case.json").write_text("{}")
    assert [r.case_id for r in stores.folders(spark, str(tmp_path)).collect()] == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True, ["a", "b"])], "i int, f boolean, l array<string>")
    for _ in range(2):
        sinks.publish(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    sinks.export_file(sinks.spelled(df), str(tmp_path / "m.csv"))
    assert (tmp_path / "m.csv").read_text().splitlines() == ["i,f,l", "1,1,a+b"]
    with pytest.raises(sinks.EmptyTable):
        sinks.export_file(df.where("i > 5"), str(tmp_path / "none.csv"))
    assert not (tmp_path / "none.csv").exists()


def test_a_failed_swap_keeps_the_old_version(spark, tmp_path, monkeypatch):
    old, new = (spark.createDataFrame([(i,)], "i int") for i in (1, 2))
    table, file, text = str(tmp_path / "t"), str(tmp_path / "m.csv"), str(tmp_path / "d.json")
    sinks.publish(old, table)
    sinks.export_file(old, file)
    sinks.write_document(spark, text, {"v": 1})
    whole = sinks.swap

    def failing(how):
        def rename(fs, a, b):
            if ".staging-" in a.toString():
                if how == "raises":
                    raise OSError("the store is away")
                return False
            return fs.rename(a, b)

        return lambda spark, staged, path: whole(spark, staged, path, rename)

    for how in ("raises", "false"):
        monkeypatch.setattr(sinks, "swap", failing(how))
        for write in (lambda: sinks.publish(new, table), lambda: sinks.export_file(new, file), lambda: sinks.write_document(spark, text, {"v": 2})):
            with pytest.raises(OSError):
                write()
        assert spark.read.parquet(table).first().i == 1 and (tmp_path / "m.csv").read_text().split() == ["i", "1"] and json.loads((tmp_path / "d.json").read_text()) == {"v": 1}
        assert not [p.name for p in tmp_path.iterdir() if "staging" in p.name or "retired" in p.name and not p.name.endswith(".crc")]
    monkeypatch.setattr(sinks, "swap", whole)
    sinks.publish(new, table)
    assert spark.read.parquet(table).first().i == 2


def test_a_swap_cut_off_between_its_renames_is_taken_back(spark, tmp_path):
    sinks.publish(spark.createDataFrame([(1,)], "i int"), str(tmp_path / "t"))
    (tmp_path / "t").rename(tmp_path / "t.retired-0")  # as if the driver had died there
    assert sinks.recover(spark, str(tmp_path / "t")) and spark.read.parquet(str(tmp_path / "t")).first().i == 1
    assert not sinks.recover(spark, str(tmp_path / "t")) and not sinks.recover(spark, str(tmp_path / "none"))


def test_documents(spark, tmp_path):
    value = {1: (np.int64(2), np.float32(0.5)), "p": tmp_path, "a": np.arange(2), "s": {"b", "a"}, "n": None, "é": True, "r": spark.range(1).first()}
    path = tmp_path / "case.json"
    for _ in range(2):
        sinks.write_document(spark, str(path), value)
    assert json.loads(path.read_text(encoding="utf-8")) == {"1": [2, 0.5], "p": str(tmp_path), "a": [0, 1], "s": ["a", "b"], "n": None, "é": True, "r": {"id": 0}}
    assert "é" in path.read_text(encoding="utf-8")


def test_transforms_and_reports(spark):
    rows = [("c", "PVP", "identity", None, True, []), ("c", "AP", "affine", 0.9, True, [1.0, 0.0])]
    chosen = spark.createDataFrame(rows, "case_id string, phase string, method string, dice double, usable boolean, parameters array<double>")
    t = sinks.transforms(chosen, "PVP").collect()
    assert [(r.transform, r.parameters) for r in t] == [("resampling_transform_pvp_to_ap", [1.0, 0.0])] and "AP" in t[0].semantics and "{" not in t[0].semantics
    lines = sinks.report(chosen.orderBy("phase"), "candidates", 1).splitlines()
    assert lines[0] == "candidates" and lines[1].split() == chosen.columns and lines[2].startswith("c        AP") and lines[-1] == "..."


def write_lines(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip("knv", p, strict=True))) for p in rows))


def test_stream_keeps_the_last_record(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    args = (spark, str(tmp_path / "in"), "k string, n int, v string", out, str(tmp_path / "check"), ["k"], "n")
    for i, part in enumerate(([(f"k{j}", 1, "x") for j in range(40)], [("k3", 2, "z"), ("k7", 0, "old"), ("new", 1, "y")])):
        write_lines(tmp_path / "in", f"{i}.json", part)
        before = {p.name: p.stat().st_ino for p in (tmp_path / "out").iterdir()} if i else {}
        incremental.follow(*args, parts=16).awaitTermination(60)
    got = {r.k: r.v for r in incremental.read_latest(spark, out).collect()}
    assert got == {f"k{j}": "x" for j in range(40)} | {"k3": "z", "new": "y"}
    same = [n for n, i in before.items() if (tmp_path / "out" / n).stat().st_ino == i]
    assert len(same) >= len(before) - 3  # a batch touches the parts of its keys only
    items = spark.createDataFrame([("k1",), ("c",)], "k string")
    assert [r.k for r in incremental.todo(items, incremental.read_latest(spark, out), ["k"]).collect()] == ["c"]


def test_a_failed_batch_is_merged_again(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    args = (spark, str(tmp_path / "in"), "k string, n int, v string", out, str(tmp_path / "check"), ["k"], "n")
    write_lines(tmp_path / "in", "0.json", [("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")])
    incremental.follow(*args, parts=8).awaitTermination(60)
    write_lines(tmp_path / "in", "1.json", [("a", 2, "y"), ("b", 2, "y"), ("c", 2, "y")])
    calls = []

    def swap(spark, staged, path):
        calls.append(path)
        if len(calls) > 1:
            raise OSError("the store is away")
        sinks.swap(spark, staged, path)

    monkeypatch.setattr(incremental, "swap", swap)
    with pytest.raises(Exception, match="the store is away"):
        incremental.follow(*args, parts=8).awaitTermination(60)
    rows = incremental.read_latest(spark, out).collect()
    assert sorted(r.k for r in rows) == ["a", "b", "c"] and {r.v for r in rows} <= {"x", "y"}
    monkeypatch.setattr(incremental, "swap", sinks.swap)
    incremental.follow(*args, parts=8).awaitTermination(60)
    assert {r.k: r.v for r in incremental.read_latest(spark, out).collect()} == {"a": "y", "b": "y", "c": "y"}


def test_plan():
    names = lambda s: [x.name for x in s]
    assert names(stages.plan({"a": True, "b": False}, False)) == ["measure", "solve", "convert", "convert", "label"]
    assert names(stages.plan({"a": True}, True)) == ["convert", "label"] and names(stages.plan({"b": False}, False)) == ["convert", "label"]
    assert "geometry" in stages.explain(stages.plan({"a": True}, True))
    assert stages.root_of("b", {"b": "/x"}, "/p", lambda p: True) == "/x"
    assert stages.root_of("b", {}, "/p", lambda p: True) == "/p/b"
    with pytest.raises(ValueError):
        stages.plan({}, False)
    with pytest.raises(FileNotFoundError):
        stages.root_of("b", {}, "/p", lambda p: False)
    seen = []
    stages.run(stages.plan({"b": False}, True), {"convert": lambda s: seen.append(s.options["dataset"]), "label": lambda s: None})
    assert seen == ["b"]
