"""Delimited text in and out, histories."""

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import history, text_io


def read(spark, tmp_path, raw, **options):
    path = tmp_path / f"{abs(hash((raw, str(options))))}.csv"
    path.write_bytes(raw)
    df = text_io.read_delimited(spark, str(path), **options)
    return df.columns, sorted((tuple(r) for r in df.collect()), key=str)


def test_read_delimited(spark, tmp_path):
    assert read(spark, tmp_path, b"title\nmore;\n;;\nid;name;\n1;a\n\n2;b;c;d\n", skip=2, delimiter=";") == (["id", "name", "c3", "c4"], [("1", "a", None, None), ("2", "b", "c", "d")])
    assert read(spark, tmp_path, b"\xef\xbb\xbfid,name\r\n1,x\r\n") == (["id", "name"], [("1", "x")])
    assert read(spark, tmp_path, "이름,값\n홍길동,1\n".encode("cp949")) == (["이름", "값"], [("홍길동", "1")])
    assert read(spark, tmp_path, '이름,값\n"홍\n길동",1\n'.encode("cp949")) == (["이름", "값"], [("홍\n길동", "1")])
    assert read(spark, tmp_path, b'a,b\n"x\ny",1\n"q ""z""",2\n') == (["a", "b"], [('q "z"', "2"), ("x\ny", "1")])
    assert read(spark, tmp_path, b"1|2\n3|4\n", header=False) == (["c1", "c2"], [("1", "2"), ("3", "4")])
    assert read(spark, tmp_path, b"a,A,\n1,2,3\n") == (["a", "A_", "c3"], [("1", "2", "3")])
    assert read(spark, tmp_path, b"\n\n") == (["value"], [])


def test_delimiters():
    assert [text_io.sniff_delimiter(x) for x in (["a;b,c", "d;e"], ["a\tb", "c\td"], ["plain"], ['"a,b";c', "1;2"])] == [";", "\t", ",", ";"]


def test_import_with_errors(spark):
    kinds = T.StructType([T.StructField("n", T.DecimalType(10, 2)), T.StructField("d", T.TimestampNTZType()), T.StructField("t", T.StringType())])
    text = spark.createDataFrame([("1,234.5", "2024/1/2", " x "), ("$ 7", "", ""), ("no", "2024/1/2", "y"), (None, "bad", "z")], "n string, d string, t string")
    good, said = text_io.imported(text, kinds, {"d": "YYYY/MM/DD"})
    assert sorted(map(str, (tuple(r) for r in good.collect()))) == sorted([str((__import__("decimal").Decimal("1234.50"), datetime.datetime(2024, 1, 2), "x")), str((__import__("decimal").Decimal("7.00"), None, None))])
    assert (said["total"], said["inserted"], said["failed"], [e[1] for e in sorted(said["errors"], key=str)]) == (4, 2, 2, [["n"], ["d"]])
    try:
        text_io.imported(text, kinds, {"d": "YYYY/MM/DD"}, skip_errors=False)
        raise AssertionError
    except text_io.Stopped as e:
        assert "2 rows" in str(e)
    assert text_io.insert_statement("t", {"N": T.DecimalType(), "D": T.TimestampNTZType()}, {"D": "YYYY-MM-DD HH24:MI:SS.FF"}) == "INSERT INTO t (N, D) VALUES (:1, TO_TIMESTAMP(:2, 'YYYY-MM-DD HH24:MI:SS.FF'))"
    assert text_io.match_columns(["Cust Id", "x"], ["CUST_ID", "Y"]) == {"Cust Id": "CUST_ID"}
    assert text_io.preview(text, 2)[1] == 4


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a"b', datetime.datetime(2024, 1, 2, 3, 4, 5, 600000), datetime.date(2024, 1, 2), b"x", None)], "k int, t string, ts timestamp_ntz, d date, raw binary, n string")
    text_io.write_csv(df.select("k", "t", "n"), str(tmp_path / "out"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert raw == b'k,t,n\r\n1," a""b",\r\n'
    line = text_io.insert_script(df.withColumnRenamed("n", "ROWID"), "t", one_line=False).first().line
    assert line == "INSERT INTO t (k, t, ts, d, raw)\nVALUES (1, ' a\"b', TO_TIMESTAMP('2024-01-02 03:04:05.600000', 'YYYY-MM-DD HH24:MI:SS.FF'), TO_DATE('2024-01-02', 'YYYY-MM-DD'), NULL);"
    assert df.select(text_io.tsv_line(df.select("k", "t")).alias("x")).first().x == '1\t" a""b"'
    assert df.select(text_io.html_row(df.select("k", F.lit("<&\n").alias("t")).select("k")).alias("x")).first().x == "<tr><td>1</td></tr>"
    assert tuple(text_io.shown(df, 2).first())[:2] == ("1", ' a…') and text_io.shown(df).first().raw == "(BINARY)"


def test_histories(spark, tmp_path):
    cut = lambda t, n: spark.range(1).select(history.cut_bytes(F.lit(t), n).alias("x")).first().x
    assert [cut("aé日🙂", n) for n in range(1, 11)] == ["a", "a", "aé", "aé", "aé", "aé日", "aé日", "aé日", "aé日", "aé日🙂"]
    t = datetime.datetime
    log = spark.createDataFrame([(t(2024, m, 3), "p", "u", "select  1", "query", 1, 1, None) for m in (1, 2, 2, 3)], "t timestamp, profile string, user string, sql string, kind string, ms bigint, rows bigint, error string")
    history.append(log, str(tmp_path / "h"))
    got = history.read(spark, str(tmp_path / "h"))
    assert got.count() == 4 and sorted(p.name for p in (tmp_path / "h").glob("month=*")) == ["month=2024-01", "month=2024-02", "month=2024-03"]
    assert history.last_months(got, 2).count() == 3 and history.grouped(got).first().n == 4
    events = spark.createDataFrame([(t(2024, 1, d), "p", "lost", str(d), 1, 1, "") for d in (3, 1, 2)], history.CONNECTIONS)
    history.append_connections(events, str(tmp_path / "c"))
    assert [r.code for r in history.connections_since(spark, str(tmp_path / "c"), t(2024, 1, 2)).collect()] == ["2", "3"]
    buckets = spark.createDataFrame([("a", 9, 0.1), ("b", 3, 0.9), ("c", 5, 0.15), ("d", 6, 0.4)], "bucket string, n int, rate double")
    assert [r.bucket for r in history.too_large(buckets, F.col("bucket")).collect()] == ["d"]
