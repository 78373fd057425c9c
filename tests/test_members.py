"""Folders, ZIP and tar.gz archives as tables of members."""

import hashlib
import io
import os
import stat
import tarfile
import zipfile

import pytest

from docloom.sources import members

KEYED = "k string, path string"


def frame(spark, *paths):
    return spark.createDataFrame([(f"k{i}", str(p)) for i, p in enumerate(paths)], KEYED)


def zip_of(path, *entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body, attr in entries:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED if len(body) > 20 else zipfile.ZIP_STORED
            info.create_system, info.external_attr = 3, attr << 16
            z.writestr(info, body)
    return path


FILE, LINK, DIR, FIFO = stat.S_IFREG | 0o644, stat.S_IFLNK | 0o777, stat.S_IFDIR | 0o755, stat.S_IFIFO | 0o644


def rows_of(df):
    return {r.name: (r.sha256, r.problem) for r in df.collect()}


def sha(body):
    return hashlib.sha256(body).hexdigest()


def test_zip_members_and_policy(spark, tmp_path):
    big = os.urandom(700_000) + b"a" * 700_000
    path = zip_of(
        tmp_path / "a.zip",
        ("doc/a.html", b"x" * 50, FILE), ("doc/big.bin", big, FILE), ("doc/empty", b"", FILE), ("doc/", b"", DIR),
        ("doc/link", b"a.html", LINK), ("doc/pipe", b"", FIFO), ("../out", b"x", FILE), ("/abs", b"x", FILE), ("doc//two", b"x", FILE), ("doc/./dot", b"x", FILE), ("a\\b", b"x", FILE), ("doc/‮x", b"x", FILE),
        ("doc/Case", b"x", FILE), ("doc/case", b"y", FILE), ("café", b"1", FILE), ("café", b"2", FILE), ("top", b"x", FILE), ("top/below", b"x", FILE), ("doc/suid", b"x", FILE | 0o4000),
    )
    got = rows_of(members.read_members(members.zip_members(frame(spark, path), "k"), "k"))
    assert {n: p for n, (_, p) in got.items()} == {
        "doc/a.html": None, "doc/big.bin": None, "doc/empty": None, "doc/": None, "doc/link": "link", "doc/pipe": "special file", "../out": "name", "/abs": "name", "doc//two": "name", "doc/./dot": "name", "a\\b": "name", "doc/‮x": "name",
        "doc/Case": "folded name", "doc/case": "folded name", "café": "folded name", "café": "folded name", "top": "file and folder", "top/below": "file and folder", "doc/suid": "permissions",
    }
    assert got["doc/big.bin"][0] == sha(big) and got["doc/a.html"][0] == sha(b"x" * 50) and got["doc/empty"][0] == sha(b"") and got["doc/"][0] is None and got["../out"][0] is None


def test_zip_repeated_names_limits_and_bodies(spark, tmp_path):
    with pytest.warns(UserWarning):
        path = zip_of(tmp_path / "a.zip", ("a", b"1", FILE), ("a", b"2", FILE), ("b", b"12345678", FILE), ("c", b"123", FILE))
    found = members.zip_members(frame(spark, path), "k", limits=members.Limits(file_bytes=5))
    rows = members.read_members(found, "k", body_limit=2).collect()
    assert sorted((r.name, r.problem, r.body and bytes(r.body)) for r in rows) == [("a", "repeated name", None)] * 2 + [("b", "size", None), ("c", None, None)]
    found = members.zip_members(frame(spark, path), "k", limits=members.Limits(total_bytes=10))
    assert {r.problem for r in found.collect()} == {"repeated name", "total size"}
    (c,) = [r for r in members.read_members(members.zip_members(frame(spark, path), "k"), "k", body_limit=5).collect() if r.name == "c"]
    assert bytes(c.body) == b"123"


def test_broken_zips(spark, tmp_path):
    good = zip_of(tmp_path / "good.zip", ("a", b"hello" * 100, FILE), ("b", b"world" * 100, FILE))
    data = bytearray(good.read_bytes())
    data[36] ^= 0xFF
    (tmp_path / "bad.zip").write_bytes(data)
    (tmp_path / "no.zip").write_bytes(b"no zip")
    got = members.read_members(members.zip_members(frame(spark, good, tmp_path / "bad.zip", tmp_path / "no.zip", tmp_path / "none.zip"), "k"), "k").collect()
    assert sorted((r.k, str(r.name), r.problem) for r in got) == [("k0", "a", None), ("k0", "b", None), ("k1", "a", "content"), ("k1", "b", None), ("k2", "None", "no archive"), ("k3", "None", "no archive")]


def test_a_directory_that_lies_about_sizes(spark, tmp_path):
    path = zip_of(tmp_path / "a.zip", ("a", b"x" * 100_000, FILE))
    found = members.zip_members(frame(spark, path), "k")
    rows = found.withColumn("size", found.size - 1).unionByName(found.withColumn("size", found.size + 1))
    assert [r.problem for r in members.read_members(rows, "k").collect()] == ["content", "content"]


def test_tar_members_and_policy(spark, tmp_path):
    path = tmp_path / "a.tar.gz"
    with tarfile.open(path, "w:gz") as tar:

        def add(name, body=b"", **kw):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            for k, v in kw.items():
                setattr(info, k, v)
            tar.addfile(info, io.BytesIO(body))

        add("doc/a", b"hello")
        add("doc", type=tarfile.DIRTYPE)
        add("doc/link", type=tarfile.SYMTYPE, linkname="a")
        add("doc/hard", type=tarfile.LNKTYPE, linkname="doc/a")
        add("doc/dev", type=tarfile.CHRTYPE)
        add("../x", b"x")
        add("A/b", b"1")
        add("a/B", b"2")
        add("doc/set", b"x", mode=0o4755)
    cut = tmp_path / "cut.tar.gz"
    cut.write_bytes(path.read_bytes()[:-60])
    (tmp_path / "no.tar.gz").write_bytes(b"nothing")
    rows = members.tar_members(frame(spark, path, tmp_path / "no.tar.gz"), "k").collect()
    assert {r.name: r.problem for r in rows if r.k == "k0"} == {"doc/a": None, "doc": None, "doc/link": "link", "doc/hard": "link", "doc/dev": "special file", "../x": "name", "A/b": "folded name", "a/B": "folded name", "doc/set": "permissions"}
    assert [r.sha256 for r in rows if r.name == "doc/a"] == [sha(b"hello")] and [(r.name, r.problem) for r in rows if r.k == "k1"] == [(None, "no archive")]
    assert "cut off" in {r.problem for r in members.tar_members(frame(spark, cut), "k").collect()}
    few = members.tar_members(frame(spark, path), "k", limits=members.Limits(members=2)).collect()
    assert [r.problem for r in few if r.name is None] == ["too many members"] and len(few) == 3


@pytest.mark.parametrize("kind", ["zip", "tar.gz"])
def test_written_archives_are_read_back(spark, tmp_path, kind):
    data = [(f"g{i % 3}", f"d/{i:03d}", os.urandom(i * 40)) for i in range(200)] + [("g9", "only", None)]
    files = spark.createDataFrame(data, "k string, name string, body binary")
    made = members.stored(members.write_archives(files, "k", str(tmp_path / "out"), kind), "made")
    assert {r.k: r.members for r in made.collect()} == {"g0": 67, "g1": 67, "g2": 66, "g9": 1}
    found = members.read_members(members.zip_members(made, "k"), "k") if kind == "zip" else members.tar_members(made, "k")
    assert {(r.k, r.name, r.sha256, r.problem) for r in found.collect()} == {(k, n, sha(b or b""), None) for k, n, b in data}


def test_verified_archives_tell_refused_members(spark, tmp_path):
    files = spark.createDataFrame([("a", "x", b"1"), ("b", "y", b"2"), ("b", "../z", b"3")], "k string, name string, body binary")
    assert {r.k: r.verified for r in members.verified_archives(files, "k", str(tmp_path / "out")).collect()} == {"a": True, "b": False}


def test_folders_are_listed_by_subtrees(spark, tmp_path, monkeypatch):
    names = [f"d{i % 5}/e{i % 7}/f{i}" for i in range(100)] + ["top"]
    data = [(n, b"x" * i) for i, n in enumerate(names)] + [("../bad", b"x"), (None, b"x")]
    written = members.write_files(spark.createDataFrame(data, "name string, body binary"), str(tmp_path / "t")).collect()
    assert sorted(str(r.name) for r in written if r.problem) == ["../bad", "None"] and not (tmp_path / "bad").exists()
    os.symlink("/etc", tmp_path / "t" / "d0" / "away")
    os.mkfifo(tmp_path / "t" / "pipe")
    got = {r.path: (r.size, r.problem) for r in members.list_folder(spark, str(tmp_path / "t")).collect()}
    assert got == {n: (i, None) for i, n in enumerate(names)} | {"d0/away": (None, "link"), "pipe": (None, "special file")}
    reader = members._FolderReader(str(tmp_path / "t"))
    for least in (1, 3, 1000):
        monkeypatch.setattr(members, "SUBTREES", least)
        found = [row[0] for p in reader.partitions() for row in reader.read(p)]
        assert sorted(found) == sorted(got)


def test_archives_are_read_once_and_judged_without_python(spark, tmp_path):
    """names are folded where they are read, so no task holds two workers,
    and judging reads the stored members, not the archives again."""
    files = spark.createDataFrame([("a", n, b"x") for n in ("p/Café", "p/café", "P", "q/Straße/1", "q/STRASSE/2", "r")], "k string, name string, body binary")
    for kind, read in (("zip", members.zip_members), ("tar.gz", members.tar_members)):
        made = members.stored(members.write_archives(files, "k", str(tmp_path / kind), kind), "made")
        judged = read(made, "k")
        plan = judged._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "EvalPython" not in plan
        got = {r.name: r.problem for r in judged.collect()}
        assert got.pop("r") is None and len(got) == 5
        assert set(got.values()) == {"folded name"}
