"""The data source of raw recordings: values, ranges of bytes, pushed conditions, broken files."""

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from neurospan.sinks.recordings import write_brainvision
from neurospan.sources import edf
from neurospan.sources import signals as sg
from tests.test_sources_and_steps import edf_bytes


def brainvision(folder, name, x, kind="INT_16", vectorized=False, data=None):
    dtype = sg.BINARY[kind]
    channels = "\n".join(f"Ch{i + 1}=E{i}\\1x,,{0.5 if kind == 'INT_16' else ''},µV" for i in range(len(x)))
    data = data or f"{name}.eeg"
    (folder / f"{name}.vhdr").write_text(f"Header\n; note=1\n[Common Infos]\nDataFile={data}\nDataFormat=BINARY\nDataOrientation={'VECTORIZED' if vectorized else 'MULTIPLEXED'}\nNumberOfChannels={len(x)}\nSamplingInterval=4000\n[Binary Infos]\nBinaryFormat={kind}\n[Channel Infos]\n{channels}\n")
    body = np.asarray(x) / (0.5 if kind == "INT_16" else 1)
    (folder / data).write_bytes((body if vectorized else body.T).astype(dtype).tobytes())


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(3, 1000)) * 40)
    brainvision(tmp_path, "a", x)
    (tmp_path / "deep").mkdir()
    brainvision(tmp_path / "deep", "b", x / 7, "IEEE_FLOAT_32", True, "other.bin")
    (tmp_path / "c.EDF").write_bytes(edf_bytes([50 * np.sin(np.arange(500) / 9), np.linspace(-90, 90, 500)], 100))
    (tmp_path / "d.bdf").write_bytes(edf_bytes([np.linspace(-90, 90, 300)], 100, True))
    return tmp_path, x


def test_values_of_all_formats(spark, folder):
    path, x = folder
    for block in (97, 1000, 32 << 20):  # blocks that cut records give the same rows
        rows = sg.read_signals(spark, f"file://{path}", block).groupBy("path", "channel", "sfreq", "unit").agg(F.sort_array(F.collect_list(F.struct("sample", "time", "value"))).alias("s")).collect()
        got = {(r["path"].rsplit("/")[-1], r["channel"]): r for r in rows}
        assert set(got) == {*(("a.vhdr", f"E{i},x") for i in range(3)), *(("b.vhdr", f"E{i},x") for i in range(3)), ("c.EDF", "C0"), ("c.EDF", "C1"), ("d.bdf", "C0")}
        for (file, channel), r in got.items():
            values = np.array([s["value"] for s in r["s"]])
            assert [s["sample"] for s in r["s"]] == list(range(len(values)))
            assert np.allclose([s["time"] for s in r["s"]], np.arange(len(values)) / r["sfreq"])
            if file[0] in "ab":
                assert r["sfreq"] == 250 and np.allclose(values, x[int(channel[1])] / (1 if file[0] == "a" else 7), atol=1e-4)
        old = {(r["path"].rsplit("/")[-1], r["channel"]): r["values"] for r in edf.read_recordings(spark, f"file://{path}", "*.{EDF,bdf}").collect()}
        assert len(old) == 3 and all(np.allclose([s["value"] for s in got[k]["s"]], v) for k, v in old.items())


def count(path, filters, block=1 << 20):
    """Rows and bytes read where filters are pushed."""
    reader = sg.SignalReader({"path": str(path), "blockBytes": str(block)})
    assert list(reader.pushFilters(filters)) == filters
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    return n, reader.bytes_read


def test_pushed_conditions_read_fewer_bytes(tmp_path):
    x = np.zeros((4, 200_000))
    brainvision(tmp_path, "m", x)
    brainvision(tmp_path, "v", x, vectorized=True)
    (tmp_path / "e.edf").write_bytes(edf_bytes([np.zeros(500_000)] * 4, 50_000))
    for name, records in (("m.vhdr", 200_000), ("v.vhdr", 200_000), ("e.edf", 500_000)):
        every, most = count(tmp_path / name, [])
        assert every == 4 * records and most >= 8 * records
        rate = 250 if name != "e.edf" else 50_000
        some, fewer = count(tmp_path / name, [ds.GreaterThanOrEqual(("time",), 0.5 * records / rate), ds.LessThan(("time",), 0.6 * records / rate)])
        assert 0.1 * every <= some < 0.45 * every and fewer < 0.45 * most
        some, fewer = count(tmp_path / name, [ds.EqualTo(("sample",), records // 2)])
        assert 0 < some < 0.2 * every and fewer < 0.2 * most
        one, fewer = count(tmp_path / name, [ds.In(("channel",), ("E2,x", "C2"))])
        assert one == records and (fewer < 0.3 * most or name == "m.vhdr")
        assert count(tmp_path / name, [ds.EqualTo(("path",), "elsewhere")]) == (0, 0)


def test_conditions_leave_the_rows_of_the_whole(spark, folder):
    path, _ = folder
    whole = sg.read_signals(spark, f"file://{path}", 500)
    where = [F.col("channel") == "E1,x", F.col("channel").isin("C0", "E2,x"), (F.col("time") > 0.3) & (F.col("time") <= 0.9), F.col("sample") == 77, (F.col("sample") >= 10) & (F.col("time") < 0.5), F.col("path").endswith("a.vhdr") & (F.col("sample") < 5)]
    kept = whole.cache()
    for condition in where:
        pushed = sg.read_signals(spark, f"file://{path}", 500).filter(condition)
        assert sorted(map(tuple, pushed.collect()), key=repr) == sorted(map(tuple, kept.filter(condition).collect()), key=repr) != []
    kept.unpersist()


def test_broken_files_are_rows(spark, tmp_path):
    (tmp_path / "short.edf").write_bytes(b"0" * 100)
    (tmp_path / "odd.bdf").write_bytes(b"x" * 600)
    (tmp_path / "no.vhdr").write_text("[Common Infos]\nDataFile=gone.eeg\n")
    (tmp_path / "x.set").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("")
    (tmp_path / "empty.edf").write_bytes(edf_bytes([np.zeros(0)], 100))
    rows = sg.read_signals(spark, f"file://{tmp_path}").collect()
    assert sorted(r["path"].rsplit("/")[-1] for r in rows) == ["no.vhdr", "odd.bdf", "short.edf", "x.set"]
    assert all(r["error"] and r["channel"] is None for r in rows)


def test_written_recordings_come_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = {r: rng.normal(size=(n, 3)).astype("f4") for r, n in (("r1", 400), ("r2", 7), ("r3", 1))}
    df = spark.createDataFrame([(r, i, [float(v) for v in row]) for r, m in x.items() for i, row in enumerate(m)], "rec_id string, sample_idx int, values array<float>").repartition(6)
    made = {r["path"].rsplit("/")[-1]: r["samples"] for r in write_brainvision(df, f"file://{tmp_path}/out", 250.0).collect()}
    assert made == {"r1.vhdr": 400, "r2.vhdr": 7, "r3.vhdr": 1}
    rows = sg.read_signals(spark, f"file://{tmp_path}/out").collect()
    assert len(rows) == 3 * 408
    assert all(r["value"] == float(x[r["path"].rsplit("/")[-1][:-5]][r["sample"]][int(r["channel"][1])]) for r in rows)
