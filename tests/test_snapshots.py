"""Publication: failures leave the old state, corrupt snapshots are refused."""

import os

import pytest

from docloom.sources.snapshots import Corrupt, Snapshots


def frame(spark, n, word="a"):
    return spark.createDataFrame([(i, word) for i in range(n)], "k int, v string").repartition(2)


def files_of(shots, number):
    folder = os.path.join(shots.target, shots.pointers()[number]["snapshot"])
    return [os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(".parquet")]


def corrupt(file, keep_size=True):
    data = bytearray(open(file, "rb").read())
    data[len(data) // 2] ^= 0xFF
    os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    open(file, "wb").write(bytes(data) if keep_size else bytes(data[:-1]))


def test_readers_see_the_last_published_state(spark, tmp_path):
    shots = Snapshots(spark, str(tmp_path / "lib"))
    with pytest.raises(FileNotFoundError):
        shots.read()
    assert shots.publish(frame(spark, 10)) == 1
    old = shots.read()
    assert shots.publish(frame(spark, 3, "b")) == 2
    assert {tuple(r) for r in shots.read(contents=True).collect()} == {(i, "b") for i in range(3)}
    assert old.count() == 10  # a reader of the old state goes on with it
    assert shots.publish(frame(spark, 0)) == 3 and shots.read().count() == 0


def test_failed_runs_leave_the_old_state(spark, tmp_path, monkeypatch):
    shots = Snapshots(spark, str(tmp_path / "lib"))
    shots.publish(frame(spark, 5))
    with pytest.raises(ValueError, match="too few"):
        shots.publish(frame(spark, 1), validate=lambda df: "too few" if df.count() < 3 else None)
    monkeypatch.setattr(shots, "_point", lambda *a: (_ for _ in ()).throw(OSError("injected")))
    with pytest.raises(OSError, match="injected"):
        shots.publish(frame(spark, 7))
    assert shots.read(contents=True).count() == 5 and len([d for d in os.listdir(shots.target) if d.startswith("snapshot-")]) == 1


def test_of_two_runs_at_a_time_one_fails(spark, tmp_path):
    one, two = (Snapshots(spark, str(tmp_path / "lib")) for _ in range(2))
    one.publish(frame(spark, 1))
    with pytest.raises(OSError, match="another run"):
        two.publish(frame(spark, 9), validate=lambda df: one.publish(frame(spark, 2)) and None)
    assert one.read().count() == 2


@pytest.mark.parametrize("keep_size", [True, False])
def test_corrupt_snapshots_are_refused_and_recovered_from(spark, tmp_path, keep_size):
    shots = Snapshots(spark, str(tmp_path / "lib"))
    shots.publish(frame(spark, 5))
    shots.publish(frame(spark, 6))
    assert shots.recover() == 2
    corrupt(files_of(shots, 2)[0], keep_size)
    with pytest.raises(Corrupt, match="content" if keep_size else "size"):
        shots.read(contents=keep_size)
    assert shots.recover() == 3 and shots.read(contents=True).count() == 5
    corrupt(files_of(shots, 1)[0])
    with pytest.raises(Corrupt, match="no whole snapshot"):
        shots.recover()
    with pytest.raises(Corrupt):
        shots.read(contents=True)
    assert sorted(shots.pointers()) == [1, 2, 3]


def test_added_missing_and_relisted_files(spark, tmp_path):
    shots = Snapshots(spark, str(tmp_path / "lib"))
    shots.publish(frame(spark, 50))
    first = files_of(shots, 1)[0]
    more = os.path.join(os.path.dirname(first), "more.parquet")
    open(more, "wb").write(open(first, "rb").read())
    with pytest.raises(Corrupt, match="more.parquet: unknown"):
        shots.read()
    os.remove(more)
    os.rename(first, first + ".away")
    with pytest.raises(Corrupt, match="missing"):
        shots.read()
    os.rename(first + ".away", first)
    assert shots.read().count() == 50
    spark.createDataFrame([("x", 1, "y")], "name string, size long, sha256 string").write.mode("append").parquet(os.path.join(os.path.dirname(first), "_files"))
    with pytest.raises(Corrupt, match="another list"):
        shots.read()
    open(os.path.join(shots.target, "pointer-2.json"), "w").write("{")
    with pytest.raises(Corrupt, match="not a pointer"):
        shots.read()


def test_old_snapshots_go(spark, tmp_path):
    shots = Snapshots(spark, str(tmp_path / "lib"), keep=2)
    for n in range(4):
        shots.publish(frame(spark, n + 1))
    assert sorted(shots.pointers()) == [3, 4] and len([d for d in os.listdir(shots.target) if d.startswith("snapshot-")]) == 2
    assert shots.read(contents=True).count() == 4
