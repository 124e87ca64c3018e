import pytest

from plumbline.operators import select as S
from plumbline.sources import files, jdbc, stores


def test_header_row_and_metadata(spark, tmp_path):
    path = tmp_path / "pre.csv"
    path.write_text("Report,2024\nby,me,,\nid,name,price,\n1,x,2.5,\n2,y,3,\n")
    df = files.read(spark, str(path), header_row=2)
    assert df.columns == ["id", "name", "price", "_c3"]
    assert [tuple(r)[:3] for r in df.collect()] == [(1, "x", 2.5), (2, "y", 3.0)]
    assert S.drop_ghost_columns(df).columns == ["id", "name", "price"]
    assert files.metadata_rows(spark, str(path), 2).count() == 2


def test_feather(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import feather

    for i in range(3):
        feather.write_feather(pa.table({"k": [i, i + 10], "s": ["a", None]}), str(tmp_path / f"part{i}.feather"))
    df = files.read(spark, str(tmp_path), fmt="feather")
    assert sorted(r["k"] for r in df.collect()) == [0, 1, 2, 10, 11, 12] and df.filter("s is null").count() == 3


def test_unknown_extension():
    with pytest.raises(ValueError):
        files.file_type("x.docx")


def test_limit_and_offset(spark, tmp_path):
    spark.range(20).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert [r[0] for r in files.read(spark, str(tmp_path / "p"), fmt="parquet", offset=5, limit=3).collect()] == [5, 6, 7]


def test_jdbc_options():
    o = jdbc.options("PostgreSQL", "h", database="d", user="u", password="p")
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["password"] == "p" and "p@" not in o["url"]
    with pytest.raises(ValueError):
        jdbc.options("Nope")


def test_stores(spark, tmp_path):
    path = str(tmp_path / "rules")
    stores.save_rule_set(spark, path, "one", {"a": 1}, "first")
    stores.save_rule_set(spark, path, "two", {"b": 2})
    stores.save_rule_set(spark, path, "one", {"a": 3})
    assert stores.load_rule_set(spark, path, "one") == {"a": 3}
    assert sorted(r["name"] for r in stores.list_rule_sets(spark, path).collect()) == ["one", "two"]
    assert stores.delete_rule_set(spark, path, "two") and stores.load_rule_set(spark, path, "two") is None


def odd_fields(rng):
    pool = ["", "a", "x y", 'say "hi"', "two\nlines", "\n", '"', ",", 'tail"\n"', "5\" pipe", "é\n\nü", '""', "a,b\n,"]
    return [rng.choice(pool) for _ in range(3)]


@pytest.mark.parametrize("block", [40, 333, 100_000])
def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path, block):
    import csv
    import random

    rng = random.Random(block)
    rows = [[str(i), *odd_fields(rng)] for i in range(150)]
    for k in range(2):
        with open(tmp_path / f"f{k}.csv", "w", newline="") as f:
            writer = csv.writer(f, lineterminator="\r\n" if k else "\n", quoting=csv.QUOTE_ALL if k else csv.QUOTE_MINIMAL)
            writer.writerows([["made by", "me"], ["id", "a", "b\nb", "c"], *rows[k::2]])
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set(key, block)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = files.read(spark, str(tmp_path), "csv", header_row=1, schema="id string, a string, b string, c string")
        got = {r["id"]: [v or "" for v in r[1:]] for r in df.collect()}
        assert files._lines(spark, str(tmp_path)).rdd.getNumPartitions() > (1 if block < 1000 else 0)
        named = files.read(spark, str(tmp_path), "csv", header_row=1)
        assert named.columns == ["id", "a", "b\nb", "c"] and named.schema["id"].dataType.simpleString() == "bigint" and named.count() == 150
        above = files.metadata_rows(spark, str(tmp_path), 1).collect()
        assert [(r["row"], r["fields"]) for r in above] == [(0, ["made by", "me"])] * 2
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert got == {r[0]: r[1:] for r in rows}


def test_quotes_open_fields_only_where_these_begin():
    inside = lambda line, s=False: files.ends_inside(line, s, ",")
    assert not inside('a,5" pipe,b') and inside('a,"b') and not inside('a,"b""c"') and inside('"""') and not inside('""')
    assert not inside('b",c', True) and inside('b', True) and inside('b","', True) and not inside('""",x', True) and inside('b""', True)


def test_zip_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write(spark.range(1), str(tmp_path / "x.csv"), "csv", compression="zip")


def test_batches_are_named_by_their_rows(spark, tmp_path):
    import os

    df = spark.range(25).selectExpr("24 - id AS k").repartition(3)
    files.batch_export(df, str(tmp_path / "out"), 10, order_by=["k"])
    assert sorted(d for d in os.listdir(tmp_path / "out") if d.startswith("rows")) == ["rows=1-10", "rows=11-20", "rows=21-25"]
    for d, want in (("1-10", range(0, 10)), ("21-25", range(20, 25))):
        assert [r[0] for r in spark.read.parquet(str(tmp_path / "out" / f"rows={d}")).orderBy("k").collect()] == list(want)
    files.batch_export(df.limit(0), str(tmp_path / "none"), 10)


def test_late_pages(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id % 10 = 0 THEN NULL ELSE id DIV 7 END AS a", "id AS b").repartition(7)
    rows = sorted(((r["a"] is not None, r["a"] or 0, r["b"]) for r in df.collect()))
    for number in (0, 1, 13, 99, 100):
        page = S.page(df, number, 10, ["a", "b"])
        assert [r["b"] for r in page.collect()] == [x[2] for x in rows[number * 10 : number * 10 + 10]]
    ties = S.page(df, 5, 30, ["a"]).collect()
    assert [r["a"] for r in ties] == [x[1] if x[0] else None for x in rows[150:180]]
    assert S.page(df.limit(0), 0, 10, ["a"]).count() == 0


def test_feather_batches_are_tasks(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import feather

    feather.write_feather(pa.table({"k": list(range(1000))}), str(tmp_path / "one.feather"), chunksize=100)
    df = files.read(spark, str(tmp_path / "one.feather"))
    assert df.rdd.getNumPartitions() == 10 and sorted(r["k"] for r in df.collect()) == list(range(1000))


def test_quoted_blocks_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task of csv_quoted_blocks writes the whole table, and every row comes back."""
    import hashlib

    from plumbline.plans import load, storage

    texts = {i: f'a "{i}"\n, b' * (i % 5 + 1) for i in range(80)}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    seen, write = [], storage.files.write
    monkeypatch.setattr(storage.files, "write", lambda df, *a, **k: (seen.append(df.rdd.getNumPartitions()), write(df, *a, **k)))
    got = {r["doc_id"]: r["digest"] for r in load()["csv_quoted_blocks"].run(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5((t + '\n"x", y').encode()).hexdigest() for i, t in texts.items()}
    assert seen[0] > 1
