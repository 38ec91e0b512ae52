"""Statement files as a stream: each once, over runs, replays and late files; dead letters apart."""

import os

from tallyline.sources import statement_format as sf


def arrive(folder, name, text, at):
    (folder / name).write_bytes(text.encode())
    os.utime(folder / name, (at, at))


def test_files_arrive_once(spark, tmp_path):
    sf.register(spark)
    folder, kept = tmp_path / "in", str(tmp_path / "kept")
    folder.mkdir()

    def run(lag=100):
        grid = spark.readStream.format("statement").option("pathGlobFilter", "*.csv").option("lag", lag).load(str(folder))
        sf.persist_stream(grid, kept, str(tmp_path / "checkpoint"), now=True).awaitTermination()

    def held():
        good = sorted((os.path.basename(r.file), r.row_idx, r.cells) for r in sf.stored(spark, kept, False).collect())
        bad = sorted((os.path.basename(r.file), r.error) for r in sf.stored(spark, kept, True).collect())
        return good, bad

    arrive(folder, "a.csv", "a;b\n1;2\n", 1_000_000)
    arrive(folder, "empty.csv", "", 1_000_010)
    arrive(folder, "note.txt", "a;b", 1_000_010)
    run()
    first = ([("a.csv", 0, ["a", "b"]), ("a.csv", 1, ["1", "2"])], [("empty.csv", "ValueError: the file has no rows")])
    assert held() == first
    run()
    assert held() == first
    # Late by less than the lag, of one time with another file, and newer.
    arrive(folder, "late.csv", "l;m\n", 999_950)
    arrive(folder, "same.csv", "s;t\n", 1_000_010)
    arrive(folder, "new.csv", "n;o\n", 1_005_000)
    run()
    second = ([*first[0], ("late.csv", 0, ["l", "m"]), ("new.csv", 0, ["n", "o"]), ("same.csv", 0, ["s", "t"])], first[1])
    assert held() == second
    # The last batch is not committed: it is run again, with the same files; a run that begins so ends with it.
    last = max(int(n) for n in os.listdir(tmp_path / "checkpoint" / "commits") if n.isdigit())
    for n in (f".{last}.crc", str(last)):
        os.remove(tmp_path / "checkpoint" / "commits" / n)
    arrive(folder, "after.csv", "x;y\n", 1_005_001)
    run()
    assert held() == second
    run()
    assert held() == (sorted([*second[0], ("after.csv", 0, ["x", "y"])]), second[1])
    # Written anew: it comes again. Gone: it stays as it was read.
    arrive(folder, "a.csv", "c;d\n", 1_005_002)
    os.remove(folder / "same.csv")
    run()
    assert held() == (sorted([*second[0], ("after.csv", 0, ["x", "y"]), ("a.csv", 0, ["c", "d"])]), second[1])
    plan = sf.stored(spark, kept, True)._jdf.queryExecution().executedPlan().toString()
    assert "failed" in plan.split("PartitionFilters")[1]


def test_an_offset_holds_recent_files_only(tmp_path):
    for i in range(50):
        arrive(tmp_path, f"{i}.csv", "a;b", 1_000_000 + i)
    s = sf.Arrivals({"path": str(tmp_path), "lag": "9"})
    end = s.latestOffset()
    assert len(end["recent"]) == 10
    parts = s.partitions(s.initialOffset(), end)
    assert sum(len(p.files) for p in parts) == 50 and s.partitions(end, end)[0].files == []


def test_many_arrivals_leave_offsets_small(tmp_path, monkeypatch):
    monkeypatch.setattr(sf, "INLINE", 5)
    monkeypatch.setattr(sf, "AT_A_TIME", 7)
    (tmp_path / "in").mkdir()
    for i in range(40):
        arrive(tmp_path / "in", f"{i}.csv", "a;b", 1_000_000 + i)
    s = sf.Arrivals({"path": str(tmp_path / "in"), "log": str(tmp_path / "log")})
    first = s.latestOffset()
    assert len(str(first)) < 200 and s.latestOffset() == first and len(os.listdir(tmp_path / "log")) == 1
    arrive(tmp_path / "in", "late.csv", "a;b", 999_900)
    arrive(tmp_path / "in", "new.csv", "a;b", 1_000_100)
    end = s.latestOffset()
    names = lambda a, b: sorted(os.path.basename(x[0]) for p in s.partitions(a, b) for x in p.files)
    assert names(s.initialOffset(), first) == sorted(f"{i}.csv" for i in range(40)) and names(first, end) == ["late.csv", "new.csv"] and names(end, end) == []
