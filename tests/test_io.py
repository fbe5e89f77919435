from __future__ import annotations

import bz2
import gzip
import json
import lzma
import sqlite3
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pandas as pd
import pytest

import sieveworks
from sieveworks.profile import profile_df
from sieveworks.sources import readers
from sieveworks.sources.writers import write

CSV = "id;name;amount;note\n1;Ann;1.5;\n2;N/A;2.5;x\n3;\"a;b\";3.0;y\n"


def rows(df):
    return [tuple(r) for r in df.collect()]


WANT = [(1, "Ann", 1.5, ""), (2, "N/A", 2.5, "x"), (3, "a;b", 3.0, "y")]


@pytest.mark.parametrize("suffix", ["", ".gz", ".bz2", ".xz", ".zip"])
def test_text_and_compressed_text(spark, tmp_path, suffix):
    path = tmp_path / f"t.csv{suffix}"
    if suffix == ".zip":
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("t.csv", CSV)
    else:
        path.write_bytes({"": lambda b: b, ".gz": gzip.compress, ".bz2": bz2.compress, ".xz": lzma.compress}[suffix](CSV.encode()))
    assert rows(sieveworks.read(path)) == WANT


def test_header_encoding_and_blanks(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_bytes("k,k,,v\n1,2,3,caf\xe9\n4,5,,x\n".encode("cp1252"))
    df = sieveworks.read(p)
    assert df.columns == ["k", "k.1", "Unnamed: 2", "v"] and rows(df) == [(1, 2, "3", "café"), (4, 5, "", "x")]
    assert "not UTF-8" in repr(sieveworks.diagnose(p))
    p.write_bytes("﻿a,b\n1,2\n".encode())
    assert sieveworks.read(p).columns == ["a", "b"]
    assert readers.sniff(b"a\tb\n" + "é".encode() * 4094 + b"x\xc3")[1] == "utf-8" and readers.sniff(b"abc\xc3")[1] == "cp1252"


def test_other_files(spark, tmp_path):
    frame = pd.DataFrame({"a": [1, 2], "b": ["x", "y"]})
    frame.to_parquet(tmp_path / "t.parquet")
    frame.to_orc(tmp_path / "t.orc")
    frame.to_feather(tmp_path / "t.feather")
    frame.to_json(tmp_path / "t.json", orient="records", indent=2)
    frame.to_json(tmp_path / "t.jsonl", orient="records", lines=True)
    for name in ("t.parquet", "t.orc", "t.feather", "t.json", "t.jsonl"):
        assert sorted(rows(sieveworks.read(tmp_path / name).select("a", "b"))) == [(1, "x"), (2, "y")], name
    folder = tmp_path / "folder"
    folder.mkdir()
    frame.to_parquet(folder / "1.parquet")
    frame.to_parquet(folder / "2.parquet")
    assert sieveworks.read(folder).count() == 4
    with pytest.raises(ValueError, match="unsupported"):
        (tmp_path / "t.bin").write_text("x")
        sieveworks.read(tmp_path / "t.bin")
    with pytest.raises(FileNotFoundError):
        sieveworks.read(tmp_path / "none.csv")
    with pytest.raises(NotImplementedError):
        sieveworks.read("s3://bucket/x.parquet")
    assert set(readers.read_family(str(tmp_path / "t.p*"))) == {"t"}


def test_sql(spark, tmp_path):
    with sqlite3.connect(tmp_path / "d.db") as c:
        c.execute("create table t (a integer, b text)")
        c.executemany("insert into t values (?, ?)", [(1, "x"), (2, None)])
        assert rows(sieveworks.read_sql("select * from t order by a", c)) == [(1, "x"), (2, None)]
        assert rows(sieveworks.read(c, query="select a from t order by a")) == [(1,), (2,)]
        with pytest.raises(ValueError):
            sieveworks.read(c)
    assert rows(sieveworks.read(f"sqlite:///{tmp_path}/d.db", query="select count(*) as n from t")) == [(2,)]


def test_urls(spark, tmp_path):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            found = {"/d.json": ("application/json", json.dumps({"data": {"items": [{"a": 1, "b": "x"}, {"a": 2, "b": "N/A"}]}})), "/d.csv": ("text/csv", "a,b\n1,N/A\n"), "/d.html": ("text/html", "<p>")}.get(self.path)
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", found[0] if found else "text/plain")
            self.end_headers()
            self.wfile.write(found[1].encode() if found else b"")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert rows(sieveworks.read(f"{base}/d.json", records_path="data.items")) == [(1, "x"), (2, "N/A")]
        assert rows(sieveworks.read(f"{base}/d.csv")) == [("1", "N/A")]
        with pytest.raises(ValueError, match="404"):
            sieveworks.read(f"{base}/none.csv")
        with pytest.raises(ValueError, match="neither"):
            sieveworks.read(f"{base}/d.html")
        df, stamp = readers.load_url(f"{base}/d.csv", tmp_path)
        assert df.count() == stamp["rows"] == 1 and len(stamp["sha256"]) == 64
    finally:
        server.shutdown()
    with pytest.raises(ConnectionError):
        readers.fetch("http://127.0.0.1:9/x.csv", timeout=2)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"'), (2, None)], "a int, b string")
    for name in ("t.csv", "t.parquet", "t.pq", "t.jsonl", "t.ndjson", "t.json", "t.orc"):
        assert write(df, tmp_path / name).is_file()
    assert pd.read_csv(tmp_path / "t.csv").b[0] == 'a "q"' and len(json.loads((tmp_path / "t.json").read_text())) == 2
    assert sieveworks.read(tmp_path / "t.parquet").count() == 2
    assert write(df, tmp_path / "parts.parquet", single_file=False).is_dir()
    with pytest.raises(ValueError, match="unsupported"):
        write(df, tmp_path / "t.xyz")


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (4, "b|c", None)], "n int, t string, e double")
    said = profile_df(df, "t")
    assert "3 rows x 3 columns" in said and "min=1 · median=2 · max=4" in said and "'a'×2" in said and "b\\|c" in said and "| 0.0% |" in said
    assert "columns omitted" in profile_df(df, "t", char_budget=250)
    assert "0 rows" in profile_df(df.limit(0), "t")
