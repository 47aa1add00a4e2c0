import gzip
import io
import tarfile
import zipfile

import pytest

from cairn.functions.hashing import bound
from cairn.sources import files as L
from cairn.sources import tables as X
from cairn.streaming import feeds as Y


def test_csv_rules(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('a,b\n1, "say ""hi"", ok"\n\n2,x\n')
    assert [tuple(r) for r in X.read_csv(spark, str(f)).collect()] == [("1", 'say "hi", ok'), ("2", "x")]
    f.write_text(f"{bound(1)},x\n{bound(2)},y\n")
    df = X.read_csv(spark, str(f))
    assert df.columns == ["Column #0", "Column #1"] and df.count() == 2
    f.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed|FAILED_READ"):
        X.read_csv(spark, str(f)).collect()


def test_project_cache(spark, tmp_path):
    f = tmp_path / "c.txt"
    f.write_text("-----\nTITLE: One\nDESC: a\\nb\nSIZE: 12\nHASH: abc\nENCRYPTED: published\n-----\nHASH: def\nDELETED: true\n-----\n")
    got = {r.hash: r for r in X.read_project_cache(spark, str(f)).collect()}
    assert (got["abc"].title, got["abc"].description, got["abc"].size, got["abc"].encrypted, got["abc"].published) == ("One", "a\nb", 12, True, True)
    assert (got["def"].title, got["def"].hidden, got["def"].size) == ("?", True, 0)


def test_archives(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x/a.txt", "A")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        m = tarfile.TarInfo("b.txt")
        m.size = 1
        f.addfile(m, io.BytesIO(b"B"))
    for name, data in {"z.zip": z.getvalue(), "deep/t.tgz": t.getvalue(), "g.gz": gzip.compress(b"G"), "plain": b"P", "bad.zip": b"no"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    rows = L.explode_archives(L.read_tree(spark, str(tmp_path / "in"))).collect()
    got = {r.name: bytes(r.content) if r.content is not None else r.error for r in rows}
    assert got == {"z.zip/x/a.txt": b"A", "deep/t.tgz/b.txt": b"B", "g": b"G", "plain": b"P", "bad.zip": "BadZipFile"}


def test_request_log(spark, tmp_path):
    good = L.pack_entry(5, 4, "10.0.0.1", bound(7)) + L.pack_entry(6, 7, "10.0.0.2")
    bad = bytearray(L.pack_entry(7, 7, "10.0.0.3"))
    bad[8] ^= 1
    (tmp_path / "log").write_bytes(good + bytes(bad) + L.pack_entry(8, 1, "10.0.0.4", bound(1), b"s" * 16) + b"\0\0")
    got = [tuple(r) for r in L.read_request_log(spark, str(tmp_path / "log")).orderBy("ts").collect()]
    assert got == [(5, "GetData", "10.0.0.1", bound(7), None), (6, "GetNonce", "10.0.0.2", None, None), (8, "SetData", "10.0.0.4", bound(1), (b"s" * 16).hex())]


def test_progress_stream(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:10' + make_interval(0,0,0,0,0,id) AS ts, 'h' AS host, id AS amount FROM range(0, 90, 10)")
    df.write.parquet(str(tmp_path / "in"))
    got = []
    Y.run_once(Y.progress(Y.feed(spark, str(tmp_path / "in"), df.schema)), lambda b, i: got.extend(map(tuple, b.select("n", "amount").collect())), str(tmp_path / "ck"), "complete")
    assert sorted(got)[-2:] == [(9, 360)] * min(2, len(got)) or sum(n for n, _ in set(got)) == 9


def test_stream_join(spark, tmp_path):
    s = spark.sql("SELECT id AS callback, 'h' AS host, timestamp'2024-01-01 00:00:00' AS send_time FROM range(3)")
    a = spark.sql("SELECT id AS callback, timestamp'2024-01-01 00:00:02' AS answer_time FROM range(2)")
    s.write.parquet(str(tmp_path / "s"))
    a.write.parquet(str(tmp_path / "a"))
    j = Y.latencies(Y.feed(spark, str(tmp_path / "s"), s.schema), Y.feed(spark, str(tmp_path / "a"), a.schema))
    assert sorted(map(tuple, Y.collected(j, str(tmp_path / "o"), str(tmp_path / "ck")).collect())) == [(0, "h", 2000), (1, "h", 2000)]


def test_project_cache_delimiters(spark, tmp_path):
    (tmp_path / "cache").write_text("PROJECT 1\nHASH: a\nTITLE: one\nSHARE: true\nPROJECT 2\nHASH: b\nTITLE: two\n-----\nHASH: c\nDESC: PROJECT within\n")
    got = sorted(tuple(r) for r in X.read_project_cache(spark, str(tmp_path / "cache")).select("hash", "title", "description", "share").collect())
    assert got == [("a", "one", "", True), ("b", "two", "", False), ("c", "?", "PROJECT within", False)]


def test_download_list(spark, tmp_path):
    good = "ab" * 76
    df = spark.createDataFrame([(f"'{good}'", "p", ""), ("none", "q", "x")], ["My HASH", "pass word", "a Regex"])
    assert [tuple(r) for r in X.download_list(df).collect()] == [(good, "p", None, None)]
    with pytest.raises(ValueError):
        X.download_list(df.drop("My HASH"))
