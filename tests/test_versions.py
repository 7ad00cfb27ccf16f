import pytest
from pyspark.sql import functions as F

from wakeline.operators import carry
from wakeline.sources import tables as S
from wakeline.sources import versions as V
from wakeline.streaming import snapshots as R

ROWS = "imo long, day string, dest_code string"


def table(spark, n=6, days=("a", "b", None, "x=1/é")):
    return spark.createDataFrame([(i, d, f"{d}{i}") for d in days for i in range(n)], ROWS)


def state(spark, root, name="rows"):
    return sorted((tuple(r) for r in V.read(spark, root, name).collect()), key=repr)


def test_update_writes_touched_partitions_only(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    draft = V.Draft(spark, root)
    draft.replace(table(spark).filter("not (coalesce(day, '') = 'b' and imo > 3)"), partition="day")
    draft.commit()
    before = {f[1]: f[0] for f in V.current(spark, root)[1]["tables"]["rows"]["folders"]}
    source = spark.createDataFrame([(5, "new", 1), (5, "newer", 2), (0, "no", 1), (None, "no", 1), (77, "no", 1)], "imo long, dest_code string, at long")
    assert set(V.update_table(spark, root, source, "imo", ["dest_code"], "at")) == {"a", None, "x=1/é"}
    after = {f[1]: f[0] for f in V.current(spark, root)[1]["tables"]["rows"]["folders"]}
    assert [v for f, v in after.items() if f in before] == ["b"]
    want = [(i, d, "newer" if i == 5 else f"{d}{i}") for d in ("a", "b", None, "x=1/é") for i in range(6) if not (d == "b" and i > 3)]
    assert state(spark, root) == sorted(want, key=repr)
    assert V.read(spark, root, values=["b"]).count() == 4
    with pytest.raises(ValueError):
        V.update_table(spark, root, source.withColumn("day", F.lit("b")), "imo", ["day"], "at")


def test_crash_between_steps(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    V.Draft(spark, root).replace(table(spark))  # never committed: there is no table
    with pytest.raises(ValueError):
        V.read(spark, root)
    draft = V.Draft(spark, root)
    draft.replace(table(spark), "rows", "day")
    draft.replace(table(spark, 1), "result")
    draft.commit()
    before, result = state(spark, root), state(spark, root, "result")
    source = spark.createDataFrame([(1, "new", 1)], "imo long, dest_code string, at long")
    for step in ("write", "commit"):
        with monkeypatch.context() as m:
            real = getattr(V.Draft, step)

            def crash(self, *args, step=step, real=real):
                if step == "write":
                    real(self, *args)
                raise KeyboardInterrupt

            m.setattr(V.Draft, step, crash)
            with pytest.raises(KeyboardInterrupt):
                V.update_table(spark, root, source, "imo", ["dest_code"], "at")
            with pytest.raises(KeyboardInterrupt):
                d = V.Draft(spark, root)
                d.replace(table(spark, 2), "result")
                d.commit()
        assert state(spark, root) == before and state(spark, root, "result") == result
    # two writers of one version: the second one fails, the table is whole
    a, b = V.Draft(spark, root), V.Draft(spark, root)
    for d in (a, b):
        d.update(source, "imo", ["dest_code"], "at")
    a.commit()
    with pytest.raises(RuntimeError):
        b.commit()
    done = state(spark, root)
    assert ("new" in {r[2] for r in done}) and len(done) == len(before)
    V.vacuum(spark, root, 1)
    assert state(spark, root) == done and state(spark, root, "result") == result
    assert len(V.children(spark, f"{root}/_versions")) == 1 and len(V.children(spark, f"{root}/data")) == 2


def test_stream_of_updates_that_crashes_and_runs_again(spark, tmp_path, monkeypatch):
    root, source = f"file://{tmp_path}/t", tmp_path / "in"
    draft = V.Draft(spark, root)
    draft.replace(table(spark), partition="day")
    draft.commit()
    kind = "imo long, dest_code string, at long"
    source.mkdir()
    for n in range(3):
        spark.createDataFrame([(n + 1, f"batch {n}", 10 - n), (5, f"batch {n}", n)], kind).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        next((tmp_path / f"p{n}").glob("*.parquet")).rename(source / f"{n}.parquet")

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
        R.stream_upsert(stream, root, "imo", ["dest_code"], "at", f"{tmp_path}/progress", "codes").start().awaitTermination()

    real, met = V.Draft.commit, []

    def commit(self, batch=None):
        real(self, batch)
        met.append(batch)
        if len(met) == 2:  # the version is there, but the stream does not learn of it
            raise RuntimeError("crash")

    monkeypatch.setattr(V.Draft, "commit", commit)
    with pytest.raises(Exception, match="crash"):
        run()
    run()
    assert [b[1] for b in met] == [0, 1, 2]
    assert {r[0]: r[2] for r in state(spark, root) if r[1] == "a"}.items() >= {0: "a0", 1: "batch 0", 2: "batch 1", 3: "batch 2", 5: "batch 2"}.items()
    assert V.current(spark, root)[1]["batches"] == {"codes": 2}
    assert V.current(spark, root)[0] == 4


def test_exports_of_skewed_tables(spark, tmp_path):
    rows = [(1, "KRPUS", i) for i in range(5000)] + [(2 + i % 40, "GRPIR", i) for i in range(200)] + [(None, "JPTYO", 1)]
    df = spark.createDataFrame(rows, "mmsi long, dest_code string, n long").repartition(8)
    S.export_by_vessel(df, str(tmp_path / "ships"), 1000)
    files = {d.name: len(list(d.glob("*.csv"))) for d in (tmp_path / "ships").iterdir() if d.is_dir()}
    assert len(files) == 42 and 5 <= files.pop("mmsi=1") <= 10 and set(files.values()) == {1}
    assert spark.read.option("header", True).csv(str(tmp_path / "ships")).count() == len(rows)
    S.export_by_country_group(df, str(tmp_path / "groups"), max_rows_a_file=1000)
    back = spark.read.option("header", True).csv(str(tmp_path / "groups"))
    assert back.count() == df.filter("dest_code = 'GRPIR'").count() + back.filter("dest_code <> 'GRPIR'").count()
    assert all(len(list(d.glob("*.csv"))) <= 10 for d in (tmp_path / "groups").iterdir() if d.is_dir())


def test_history_is_read_backwards_as_far_as_needed(spark, tmp_path):
    rows = [(ship, day, "A" if day < 3 * ship else "B") for ship in range(1, 9) for day in range(30)]
    rows += [(20, 29, "B"), (21, 5, None), (21, 29, "B"), (0, 1, "A"), (22, 0, "Z"), (22, 1, "B")]
    path = str(tmp_path / "days")
    kind = "imo long, day int, dest_code string"
    spark.createDataFrame(rows, kind).withColumn("snapshot_ts", F.col("day")).write.partitionBy("day").parquet(path)
    history = spark.read.parquet(path)

    def ask(ships):
        df, read = carry.previous_destination_back(history, spark.createDataFrame([(s, "B") for s in ships], "imo long, asked string"), "day")
        plain = carry.previous_destination(history, spark.createDataFrame([(s, "B") for s in ships], "imo long, asked string"))
        got = {r["imo"]: r["previous_code"] for r in df.collect()}
        assert got == {r["imo"]: r["previous_code"] for r in plain.collect()}
        return got, read

    assert ask([8]) == ({8: "A"}, list(range(29, 22, -1)))  # 1 + 2 + 4 days
    got, read = ask([8, 7, 20, 21, 22, 0, 99])
    assert got == {8: "A", 7: "A", 20: "B", 21: None, 22: "Z"} and len(read) == 30
    assert ask([])[0] == {}
