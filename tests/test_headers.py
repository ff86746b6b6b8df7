"""Headers are read from the first bytes of a file, whatever its length."""

import gzip

from colprov.sources import landing as L


def harvest(spark, path):
    good, bad = L.read_headers(spark, path)
    cols = {}
    for r in sorted(good.collect(), key=lambda r: (r["file"], r["pos"])):
        cols.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["col"])
    return cols, {r["file"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()}


def test_headers_and_reasons(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"id", b ,c\r\n1,2,3\n')
    (tmp_path / "b.tsv").write_text("\n  \nx\ty\n")
    (tmp_path / "c.csv").write_text("just words\n")
    (tmp_path / "d.csv").write_text("\n\n")
    (tmp_path / "e.csv").write_text("p,q")
    (tmp_path / "f.csv.gz").write_bytes(gzip.compress(b"g,h\n1,2\n"))
    (tmp_path / "g.csv.gz").write_bytes(b"not gzip at all")
    cols, bad = harvest(spark, str(tmp_path))
    assert cols == {"a.csv": ["id", "b", "c"], "b.tsv": ["x", "y"], "e.csv": ["p", "q"], "f.csv.gz": ["g", "h"]}
    assert bad["c.csv"] == "no delimiter in the first line" and bad["d.csv"] == "empty header"
    assert bad["g.csv.gz"].startswith("unreadable")


def test_long_header_and_long_file(spark, tmp_path):
    names = [f"column_{i}" for i in range(30_000)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n1\n")
    with open(tmp_path / "long.csv", "wb") as f:
        f.write(b"a,b\n")
        f.truncate(1 << 33)  # 8 GB without a line end: only its first bytes can be read
    cols, bad = harvest(spark, f"{tmp_path}/*.csv")
    assert cols == {"wide.csv": names, "long.csv": ["a", "b"]} and bad == {}


def test_listing_reads_nothing(spark, tmp_path):
    with open(tmp_path / "long.bin", "wb") as f:
        f.truncate(1 << 33)
    row = L.files(spark, str(tmp_path)).first()
    assert row["bytes"] == 1 << 33 and row["mtime"] is not None
