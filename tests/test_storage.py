"""The shared folder, paths and files, however they are written."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.conf import RuntimeConfig

from concordat import storage
from concordat.operators.chain import Memo
from concordat.sources import catalogue


def test_fallback_folder_of_a_local_session(spark, monkeypatch):
    get = RuntimeConfig.get
    monkeypatch.setattr(RuntimeConfig, "get", lambda self, key, *a: a[0] if key == "spark.checkpoint.dir" else get(self, key, *a))
    a, b = storage.shared_folder(spark, "x"), storage.shared_folder(spark, "x")
    assert a != b and a.startswith("file:/") and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    out = storage.written(spark.range(10), a)
    assert out.count() == 10 and storage.exists(spark, f"{a}/_SUCCESS")
    storage.drop(a, b)
    assert not storage.exists(spark, a)


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_forms_of_a_local_path(spark, tmp_path, form):
    folder = form.format(tmp_path / "t")
    assert storage.qualified(spark, folder) == f"file:{tmp_path}/t"
    storage.written(spark.range(3), folder)
    store, path = storage.open_fs(folder)
    assert path == f"{tmp_path}/t" and store.get_file_info(f"{path}/_SUCCESS").is_file
    storage.drop(folder)
    assert not (tmp_path / "t").exists()


def test_default_file_system_counts(spark, tmp_path):
    """A path without a scheme is where Spark reads it, not on the machine's own disk."""
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    try:
        assert storage.qualified(spark, "/in/x") == "viewfs://store/in/x"
        storage.written(spark.range(4), "/in/x")
        assert (tmp_path / "x" / "_SUCCESS").exists() and storage.exists(spark, "/in/x")
        with pytest.raises(Exception, match="viewfs|libhdfs"):  # no silent local file
            storage.open_fs("/in/x")
        storage.drop("/in/x")
        assert not (tmp_path / "x").exists()
    finally:
        conf.set("fs.defaultFS", before)


def test_writes_of_several_threads(spark):
    before = spark.conf.get(storage.CLEANUP, None)
    folder = storage.shared_folder(spark, "threads")
    jobs = [threading.Thread(target=lambda k=k: storage.written(spark.range(1000).repartition(3), f"{folder}/{k}")) for k in range(4)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert spark.conf.get(storage.CLEANUP, None) == before
    assert [spark.read.parquet(f"{folder}/{k}").count() for k in range(4)] == [1000] * 4


def test_memo(spark, tmp_path):
    made = []
    memo = Memo(spark, str(tmp_path))
    for _ in range(2):
        assert memo.get("n", "1", lambda: made.append(1) or spark.range(5)).count() == 5
    assert made == [1]


def test_windows_letters_at_the_end_of_a_long_file(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"code,description\n" + b"".join(b"%d,plain row of a catalogue\n" % i for i in range(50_000)) + "9,café €\n".encode("cp1252"))
    assert catalogue.encoding_of(spark, str(path)) == catalogue.WINDOWS
    assert catalogue.read_csv(spark, str(path)).where("code = '9' and description like 'caf%'").first()["description"] == "café €"
    path.write_text("code,description\n9,café €\n", encoding="utf-8")
    assert catalogue.encoding_of(spark, str(path)) == "UTF-8"
    assert catalogue.read_csv(spark, str(path)).select(F.col("description")).first()[0] == "café €"
