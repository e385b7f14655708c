"""Texts of several encodings under any range size, and matrices by ranges of rows."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.plans import catalogue
from clickloom.sources import encoded, matrix_files

ALPHABET = "ab éĊ਀z "


def bodies(seed):
    """name: (encoding, bytes, lines) of files of odd lines, some with marks, long lines, or units that hold the byte of a line end."""
    r, out = random.Random(seed), {}
    for k, (name, mark) in enumerate([("utf-8", b""), ("utf-8", b"\xef\xbb\xbf"), ("latin-1", b""), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-16-le", b""), ("utf-16-be", b"")]):
        letters = "ab é ÿ" if name == "latin-1" else ALPHABET
        rows = ["plain first line é"] + ["".join(r.choice(letters if mark or name in ("utf-8", "latin-1") else "abcdefgh é") for _ in range(r.choice((0, 1, 7, 300)))) for _ in range(60)]
        out[f"f{k}.txt"] = name, mark + ("\r\n" if k % 2 else "\n").join(rows).encode(name), rows
    return out


@pytest.mark.parametrize("size", [2, 14, 64, 1000, 1 << 20])
def test_lines_are_the_same_under_any_range_size(spark, tmp_path, size):
    want = bodies(3)
    if size == 2:
        want = {k: (n, b[:120] if n != "utf-8" else b[:20], None) for k, (n, b, _) in want.items()}
    for name, (_, data, _) in want.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty.txt").write_bytes(b"")
    got = encoded.read_encoded(spark, str(tmp_path), size).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in got} == {k: v[0] for k, v in want.items()}
    for name, (code, data, _) in want.items():
        text = data.decode("utf-8-sig" if code == "utf-8" else "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else code, "replace")
        lines = [x.removesuffix("\r") for x in text.split("\n")]
        mine = [r["line"] for r in sorted(got, key=lambda r: r["begin"]) if r["path"].endswith(name)]
        assert mine == [x for x in lines if x.strip()], name


def test_one_odd_byte_at_the_end_decides_for_the_whole_file(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\n".encode() * 500 + b"\xe9\n")
    rows = encoded.read_encoded(spark, str(tmp_path / "a.txt"), 100)
    assert rows.rdd.getNumPartitions() >= 1 and {r["encoding"] for r in rows.collect()} == {"latin-1"}


def test_lines_of_a_range(tmp_path):
    data = ("x" * 5000 + "\n" + "\n" + "y" * 3 + "\nlast").encode("utf-16-le")
    (tmp_path / "a").write_bytes(data)
    for size in (2, 6, 4096, 1 << 20):
        with encoded.open_file(str(tmp_path / "a")) as f:
            got = [x for b in range(0, len(data), size) for x in encoded.lines_of_range(f, b, min(size, len(data) - b), "\n".encode("utf-16-le"))]
        assert [x.decode("utf-16-le") for _, x in got] == ["x" * 5000, "", "yyy", "last"]
        assert [b for b, _ in got] == [0, 10002, 10004, 10012]


@pytest.mark.parametrize("part,span", [(1 << 24, 1 << 24), (100, 64)])
def test_a_matrix_comes_back(spark, tmp_path, part, span):
    x = np.random.default_rng(1).normal(size=(500, 7)).astype("<f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, vec array<double>").repartition(5)
    path = str(tmp_path / "m")
    matrix_files.write_npy(df, path, part_bytes=part)
    rows = matrix_files.read_npy(spark, path, span)
    got = sorted(rows.collect())
    assert [r["row"] for r in got] == list(range(500))
    assert np.array_equal(np.array([r["vec"] for r in got], "<f4"), x)
    named = json.loads((tmp_path / "m" / "_manifest.json").read_text())["parts"]
    assert np.array_equal(np.concatenate([np.load(tmp_path / "m" / p) for p in named]), x)
    assert part > 100 or rows.rdd.getNumPartitions() > 50
    with pytest.raises(Exception, match="there is a matrix"):
        matrix_files.write_npy(df, path)
    matrix_files.write_npy(df.where("sample_id < 3"), path, dtype="<f8", overwrite=True)
    assert matrix_files.read_npy(spark, path).count() == 3
    assert len(list((tmp_path / "m").glob("*.npy"))) == len(json.loads((tmp_path / "m" / "_manifest.json").read_text())["parts"])


def test_files_of_others(spark, tmp_path):
    np.save(tmp_path / "b.npy", np.arange(12, dtype=">i4").reshape(2, 3, 2))
    np.save(tmp_path / "a.npy", np.ones((1, 6), "<f8"))
    got = sorted(map(tuple, matrix_files.read_npy(spark, str(tmp_path)).collect()))
    assert got == [(0, [1.0] * 6), (1, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), (2, [6.0, 7.0, 8.0, 9.0, 10.0, 11.0])]
    np.save(tmp_path / "c.npy", np.asfortranarray(np.ones((2, 2))))
    with pytest.raises(Exception, match="by columns"):
        matrix_files.read_npy(spark, str(tmp_path / "c.npy")).count()


@pytest.mark.parametrize("bad", [[(1, [1.0]), (2, None)], [(1, [1.0]), (2, [1.0, 2.0])], [(1, [1.0]), (2, [None])]])
def test_a_failed_write_leaves_the_matrix_as_it_was(spark, tmp_path, bad):
    path = str(tmp_path / "m")
    matrix_files.write_npy(spark.createDataFrame([(1, [5.0])], "sample_id long, vec array<double>"), path)
    with pytest.raises(Exception, match="matrix"):
        matrix_files.write_npy(spark.createDataFrame(bad, "sample_id long, vec array<double>"), path, overwrite=True)
    assert [tuple(r) for r in matrix_files.read_npy(spark, path).collect()] == [(0, [5.0])]


def test_an_empty_matrix(spark, tmp_path):
    path = str(tmp_path / "m")
    matrix_files.write_npy(spark.createDataFrame([], "sample_id long, vec array<double>"), path)
    assert matrix_files.read_npy(spark, path).count() == 0


@pytest.mark.parametrize("name", ["text_encodings", "matrix_rows"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("part", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    got = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    names = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want) and want
