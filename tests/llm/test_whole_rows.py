"""Sharding moves and writes whole rows."""

import glob

import pyarrow.parquet as pq

from lodestone.llm import shards


def test_shards_hold_whole_rows(spark, tmp_path):
    data = [(k * 7 % 50 if k % 9 else None, f"text {k} " * (k % 13), {"a": k}, [k, None], f"s{k}", k % 3) for k in range(200)] + [(3, None, None, None, None, None)] * 3
    docs = spark.createDataFrame(data, "doc_id long, text string, m map<string,long>, shard array<long>, slot string, `a.b` long")
    path = str(tmp_path / "out")
    got = shards.write_shards(docs, path, 4).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, data)) == sorted(key(r["row"]) for r in got)
    place = {(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shards.histogram_sort(docs, 4).collect()}
    assert len(place) == len(data) and {(r["row"].doc_id, r.shard, r.slot) for r in got} == {(p[0], p[3], p[4]) for p in place}
    # On disk: a folder for each shard, slots in order in each file, none missing.
    for s in range(4):
        files = [pq.ParquetFile(f).read().column("slot").to_pylist() for f in glob.glob(f"{path}/shard={s}/*.parquet")]
        assert files and all(f == sorted(f) for f in files)
        assert sorted(sum(files, [])) == list(range(sum(map(len, files))))


def test_bins_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "BIN_BYTES", 5_000)
    docs = spark.createDataFrame([(k, "x" * 1000) for k in range(200)], "doc_id long, text string")
    got = shards.write_shards(docs, str(tmp_path / "out"), 4).collect()
    assert sorted(r["row"].doc_id for r in got) == list(range(200))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r["row"].doc_id for r in order] == list(range(200)) and [r.slot for r in order if r.shard == 2] == list(range(50))
