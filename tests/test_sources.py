"""Files of code, sheets, stores."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.plans import code_facts
from tessera.sources import code_files, spreadsheet, store

PC = b"""#include <x.h>
/* EXEC SQL DELETE FROM nothing; */
EXEC SQL DECLARE c1 CURSOR FOR SELECT a FROM src WHERE k = :hv.key:ind;
static int helper(int a)
{
    EXEC SQL FOR :n INSERT INTO dst (a) VALUES (:a);
    return 0;
}
int main(int argc, char **argv) {
    char *s = "helper(";
    EXEC SQL OPEN c1;
    EXEC SQL FETCH c1 INTO :a;
    helper(1);
    EXEC SQL EXECUTE BEGIN pkg.run(:a); END; END-EXEC;
    EXEC SQL PREPARE s1 FROM "update t set a = 'x'";
    EXEC SQL EXECUTE s1;
    EXEC SQL ROLLBACK TO SAVEPOINT p;
    EXEC SQL COMMIT WORK RELEASE;
}
"""
XML = b"""<queries>
 <!-- <query id="gone">DELETE FROM gone</query> -->
 <query id="get-one"><statement><![CDATA[
   SELECT a FROM src
   #if ($x) WHERE a < $x.y #else WHERE 1 = 1 #end
 ]]></statement></query>
 <query id="dyn">DELETE FROM $table WHERE a &gt; ?</query>
 <query id="call">{ call pkg.proc(?) }</query>
 <query id="empty"/>
</queries>
"""


def facts(text):
    return {(path, fact, what, op) for _, path, fact, what, op, _ in code_facts.extract("U", text) if fact in ("table", "call", "mark")}


def test_embedded_sql():
    body = code_files.embedded_unit(PC.decode(), "PROG")
    assert len(body.split("\n")) == PC.decode().rstrip("\n").count("\n") + 1
    got = facts(body)
    assert {("HELPER", "table", "DST", "C"), ("MAIN", "table", "SRC", "R"), ("MAIN", "call", "HELPER", ""), ("MAIN", "call", "PKG.RUN", ""), ("MAIN", "mark", "dynamic", ""), ("MAIN", "mark", "transaction", "COMMIT")} <= got
    assert not any(w == "NOTHING" for _, _, w, _ in got) and "ROLLBACK" not in body
    assert body.split("\n")[5].strip().startswith("INSERT INTO dst") and code_files.embedded_unit("int main() { return 0; }", "X") is None


def test_queries_of_xml():
    body = code_files.queries_unit(XML.decode(), "Q")
    got = facts(body)
    assert {("GET_ONE", "table", "SRC", "R"), ("DYN", "mark", "dynamic", ""), ("CALL", "call", "PKG.PROC", "")} <= got and "GONE" not in body.upper().replace("GONE\"", "")
    assert code_files.queries_unit("<a/>", "X") is None


def test_units_of_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.sql").write_text("CREATE OR REPLACE PACKAGE own.p IS\n x NUMBER;\nEND;\n/\nCREATE OR REPLACE PACKAGE BODY own.p IS\n PROCEDURE a IS BEGIN NULL; END;\nEND;\n/\nSELECT 1 FROM dual;\n")
    (tmp_path / "in" / "b.pkb").write_bytes("PACKAGE BODY q IS -- 한글\nEND;\n/\n".encode("cp949"))
    (tmp_path / "in" / "z.sql").write_text("create procedure r is begin null; end;\n/\ncreate or replace procedure R is begin commit; end;\n/\n")
    (tmp_path / "p.pc").write_bytes(PC)
    (tmp_path / "q.xml").write_bytes(XML)
    (tmp_path / "readme.txt").write_text("PROCEDURE nothing IS BEGIN NULL; END;")
    got = {(r.owner, r.name, r.unit_type): r for r in code_files.read_units(spark, str(tmp_path), "me").collect()}
    assert set(got) == {("OWN", "P", "PACKAGE BODY"), ("ME", "Q", "PACKAGE BODY"), ("ME", "R", "PROCEDURE"), ("ME", "P", "PROC_BODY"), ("ME", "Q", "XML_BODY")}
    assert got["OWN", "P", "PACKAGE BODY"].spec.startswith("PACKAGE own.p") and "한글" in got["ME", "Q", "PACKAGE BODY"].text and "commit" in got["ME", "R", "PROCEDURE"].text


def test_sheets(spark, tmp_path):
    t = datetime.datetime
    df = spark.createDataFrame([(1, 2.5, "a<b", t(2024, 1, 2, 3, 4, 5), 10**16), (None, None, None, t(1850, 1, 1), 3)], "k int, x double, s string, d timestamp_ntz, big bigint")
    path = str(tmp_path / "o.xlsx")
    assert spreadsheet.write_xlsx(df, path, "SELECT 1") == 2
    names, chosen, rows = spreadsheet.read_xlsx(open(path, "rb").read())
    assert (names, chosen) == (["Result", "SQL"], "Result")
    assert rows == [["k", "x", "s", "d", "big"], ["1", "2.5", "a<b", "2024-01-02 03:04:05", str(10**16)], [None, None, None, "1850-01-01 00:00:00", "3"]]
    got = spreadsheet.read_sheet(spark, path)
    assert got.columns == ["k", "x", "s", "d", "big"] and got.count() == 2
    assert spreadsheet.read_sheet(spark, path, "SQL", header=False).first().c1 == "SELECT 1"
    import zipfile

    ods = tmp_path / "o.ods"
    x = 'xmlns:office="o" xmlns:table="t" xmlns:text="x"'
    cell = lambda kind, attrs, text: f'<table:table-cell office:value-type="{kind}" {attrs}><text:p>{text}</text:p></table:table-cell>'
    with zipfile.ZipFile(ods, "w") as z:
        z.writestr("content.xml", f'<office:c {x}><table:table table:name="S"><table:table-row>{cell("string", "", "n")}{cell("string", "", "n")}</table:table-row><table:table-row table:number-rows-repeated="2">{cell("float", chr(111) + "ffice:value=" + chr(34) + "1.0" + chr(34), "1")}{cell("boolean", "office:boolean-value=" + chr(34) + "true" + chr(34), "x")}</table:table-row></table:table></office:c>')
    got = spreadsheet.read_sheet(spark, str(ods))
    assert got.columns == ["n", "n_"] and [tuple(r) for r in got.collect()] == [("1", "1"), ("1", "1")]
    (tmp_path / "bad.xlsx").write_bytes(b"no")
    with pytest.raises(spreadsheet.SheetError):
        spreadsheet.read_sheet(spark, str(tmp_path / "bad.xlsx"))
    assert [spreadsheet.number_text(v) for v in (1.0, 1e-7, 0.25, 1e20)] == ["1", "0.0000001", "0.25", "100000000000000000000"]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "facts")
    store.save(spark.createDataFrame([("a", 1), ("b", 2)], "unit string, v int"), path)
    store.save(spark.createDataFrame([("b", 3)], "unit string, v int"), path)
    assert sorted(tuple(r) for r in store.load(spark, path).select("unit", "v").collect()) == [("a", 1), ("b", 3)]
    made = store.export_bundle({"facts": store.load(spark, path)}, str(tmp_path / "bundle"), {"who": "x"})
    assert made["tables"]["facts"]["rows"] == 2
    assert store.import_bundle(spark, str(tmp_path / "bundle"))["facts"].count() == 2
    (tmp_path / "bundle" / "manifest.json").write_text('{"format": 1, "tables": {"../x": {}}}')
    (tmp_path / "bundle" / ".manifest.json.crc").unlink(missing_ok=True)
    for bad in (str(tmp_path / "bundle"), str(tmp_path)):
        with pytest.raises(store.BadBundle):
            store.import_bundle(spark, bad)
    with pytest.raises(store.BadBundle):
        store.export_bundle({"a/b": spark.range(1)}, str(tmp_path / "other"))
    have = spark.createDataFrame([("u", 1, "old"), ("v", 5, "own"), ("w", 1, "own")], "unit string, analyzed_at int, x string")
    more = spark.createDataFrame([("u", 2, "new"), ("v", 5, "other"), ("z", 1, "new")], "unit string, analyzed_at int, x string")
    once = store.merge_bundles(have, more, ["unit"])
    want = [("u", 2, "new"), ("v", 5, "own"), ("w", 1, "own"), ("z", 1, "new")]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, store.merge_bundles(once, more, ["unit"]).collect())) == want
    assert once.select(F.count("*")).first()[0] == 4
