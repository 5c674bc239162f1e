import zipfile

from pyspark.sql import functions as F

from tessella.sources import files
from tessella.streaming import growing


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', 1.5), (2, "line\nbreak", None)], "k int, s string, x double")
    files.write_csv(df, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, files.open_table(spark, str(tmp_path / "t.csv")).collect())) == sorted(map(tuple, df.collect()))


def test_xlsx_cells(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="AB2"><v>2.5</v></c></row></sheetData></worksheet>')
    cells = files.open_table(spark, str(tmp_path / "b.xlsx"), sheet="one")
    assert cells.count() == 4
    table = files.table_of_cells(cells, {1: ("name", "string"), 28: ("x", "double")})
    assert [tuple(r) for r in table.select("name", "x").collect()] == [("ab", 2.5)]
    assert files.column_letters(28) == "AB"


def test_growing_aggregate(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "k string, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, x double").parquet(str(tmp_path / "in"))
    query = growing.appended(stream, ["k"], total=F.sum("x")).writeStream.format("memory").queryName("grown").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("grown").collect())) == [("a", 4.0), ("b", 2.0)]
