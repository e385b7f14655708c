"""Places in text files, under any split size and any build of the files."""

import json
import random

import pytest

from clickloom.plans import catalogue
from clickloom.sources import files, lines

SCHEMA = "k bigint, t string"


@pytest.fixture
def split_size(spark):
    """Splits of so many bytes, while a test runs."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def put(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(folder, n_files=5, seed=3):
    """Files of lines, some blank, broken, empty or without a last line end; all lines in order."""
    r, every = random.Random(seed), []
    folder.mkdir(exist_ok=True)
    for f in range(n_files):
        body = []
        for _ in range(r.choice((0, 1, 40, 200))):
            body.append(r.choice([json.dumps({"k": r.randrange(100), "t": "é" * r.randrange(60)}, ensure_ascii=False), "{broken", "", "[1]", '{"k": "no number"}']) if r.random() < 0.5 else json.dumps({"k": r.randrange(100), "t": "x"}))
        (folder / f"part-{f}.json").write_text("\n".join(body) + ("\n" if f % 2 and body else ""))
        every += body
    return every


@pytest.mark.parametrize("size", [50, 333, 4096, 1 << 27])
def test_places_are_the_same_under_any_split_size(spark, tmp_path, split_size, size):
    every = written(tmp_path / "in")
    split_size(size)
    got = sorted((r["place"], r["line"]) for r in lines.numbered_lines(spark, str(tmp_path / "in")).collect())
    # a file whose last line is blank and has no end has one line less for a reader of lines
    want, place = [], 0
    for f in sorted((tmp_path / "in").iterdir()):
        for line in f.read_text().splitlines():
            want.append((place, line))
            place += 1
    assert got == want
    assert sorted(map(tuple, lines.numbered_json(spark, str(tmp_path / "in"), SCHEMA).collect())) == sorted(parsed(want))
    assert sorted(map(tuple, lines.numbered_json(spark, str(tmp_path / "in"), SCHEMA, limit=57).collect())) == sorted(parsed(want[:57]))
    assert sorted(map(tuple, files.read_json_lines(spark, str(tmp_path / "in"), SCHEMA, limit=57).collect())) == sorted(r[1:] for r in parsed(want[:57]))


def parsed(numbered):
    out = []
    for place, line in numbered:
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict) and isinstance(row.get("k"), int):
            out.append((place, row["k"], row.get("t")))
    return out


def test_an_index_is_kept_and_no_line_is_shuffled(spark, tmp_path, split_size):
    every = written(tmp_path / "in", 3, seed=5)
    split_size(200)
    index = lines.line_index(spark, str(tmp_path / "in"), keep=str(tmp_path / "index"))
    assert index.agg({"lines": "sum"}).first()[0] <= len(every)
    numbered = lines.numbered_lines(spark, str(tmp_path / "in"), index=index)
    assert "Exchange hashpartitioning" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["place"] for r in numbered.select("place").collect()) == list(range(numbered.count()))


def test_no_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "empty.json").write_text("")
    assert lines.numbered_lines(spark, str(tmp_path / "in")).count() == 0
    assert lines.numbered_json(spark, str(tmp_path / "in"), SCHEMA, limit=5).count() == 0


@pytest.mark.parametrize("size", [1000, 1 << 27])
def test_first_lines_are_the_same_rows(spark, split_size, size):
    split_size(size)
    rows = catalogue.queries()["json_first_lines"](spark, "/root/testdata/sf0.001").collect()
    orders = sorted(r["o_orderkey"] for r in spark.read.parquet("/root/testdata/sf0.001/orders.parquet").collect())[:500]
    assert sorted((r["place"], r["o_orderkey"]) for r in rows) == [(k, o) for k, o in enumerate(orders) if o % 10 != 3]


def test_triples_of_a_table_function_are_spread_and_pickled(spark, tmp_path):
    """Metadata in one file of one row group is many tasks, and no row's triples are an Arrow table of their own."""
    from clickloom.plans import queries_graph

    spark.range(40).selectExpr("id as p_partkey", "'b' as p_brand", "'t' as p_type").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = queries_graph.triples_udtf(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 1 and found.count() == 2 * 26
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
