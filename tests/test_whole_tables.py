"""Queries that run over whole tables, on a fixture larger than the bounds they once had."""

from tidemark import registry

SF = "/root/testdata/sf0.01"


def test_all_events_are_spooled(spark):
    got = registry.queries()["spool_files"](spark, SF).agg({"records": "sum", "ids": "sum"}).first()
    events = spark.read.parquet(f"{SF}/events.parquet").agg({"event_id": "sum", "*": "count"}).first()
    assert events["count(1)"] > 2000
    assert (got["sum(records)"], got["sum(ids)"]) == (events["count(1)"], events["sum(event_id)"])


def test_all_frames_are_replayed(spark):
    from tidemark.sources.frames import frames

    got = registry.queries()["frames_replayed"](spark, SF).collect()
    want = sorted((r.us, r.id) for r in frames(spark, SF).where("result is not null").select("us", "id").collect())
    assert len(want) > 500
    assert [(r.us, r.id, r.place) for r in got] == [(us, i, k + 1) for k, (us, i) in enumerate(want)]


def test_files_of_one_record_each_are_spooled_in_batches(spark, tmp_path):
    """A device's ids lie far apart, so that nearly every record has a file of its own; devices and ids may be missing."""
    rows = [(k * 7919 if k % 50 else None, k % 97 if k % 31 else None) for k in range(3000)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    frame = registry.queries()["spool_files"](spark, str(tmp_path))
    want = {}
    for i, user in rows:
        n, ids = want.get(user, (0, 0))
        want[user] = n + 1, ids + (i or 0)
    assert {r.device: (r.records, r.ids) for r in frame.collect()} == want
    assert "FlatMapGroupsInPandas" not in frame._jdf.queryExecution().toString()


def test_scanned_folders_hold_runs_of_names(spark, tmp_path, monkeypatch):
    """Far fewer files than hundreds of ids, from which the same counts follow; ids with gaps, negative and huge ones."""
    from tidemark.plans import streams

    ids = [*range(0, 400_000, 70), -250, -6500, 2**62 + 12345, 2**62 + 12355]
    rows = [(i, f"src{k % 3}", None if k % 17 == 0 else "x\u00e9" * (k % 9)) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(streams, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    got = {r.label: (r.files, r.bytes, r.first) for r in registry.queries()["labelled_file_scan"](spark, str(tmp_path)).collect()}
    hundreds = lambda i: abs(i) // 100 * (1 if i >= 0 else -1)
    want = {}
    for label in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == label]
        names = {hundreds(r[0]) for r in own}
        want[label] = len(names), sum(len((r[2] or "").encode()) + 1 for r in own), str(min(names))
    assert got == want
    assert len(list((tmp_path / "folders").rglob("*.txt"))) < sum(w[0] for w in want.values()) / 20
