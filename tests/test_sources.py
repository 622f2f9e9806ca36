import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.operators import lakes as L
from limnos.session import application_folder, clean_up
from limnos.sources import tables as S


def test_csv_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("PONDNO", T.StringType()), T.StructField("DOC", T.DoubleType())])
    (tmp_path / "in.csv").write_text("PONDNO,DOC\n020329,1.5\n040768,NA\nNA,NaN\n")
    df = S.read_csv(spark, str(tmp_path / "in.csv"), schema)
    assert [tuple(r) for r in df.collect()] == [("020329", 1.5), ("040768", None), (None, None)]
    S.write_csv(df, str(tmp_path / "out"))
    assert {tuple(r) for r in S.read_csv(spark, str(tmp_path / "out"), schema).collect()} == {("020329", 1.5), ("040768", None), (None, None)}


def test_rewrite_of_what_is_read(spark, tmp_path):
    old = S.rewrite(spark.range(3).toDF("id"), str(tmp_path / "t"))
    new = S.rewrite(old.withColumn("id", F.col("id") + 10), str(tmp_path / "t"))
    assert {r.id for r in new.collect()} == {10, 11, 12} and {r.id for r in old.collect()} == {0, 1, 2}


def test_blanks_in_names_become_dots(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Visual Water Color,x\nbrown,1\n")
    assert S.read_csv(spark, str(tmp_path / "in.csv"), T.StructType([T.StructField("Visual Water Color", T.StringType()), T.StructField("x", T.IntegerType())])).columns == ["Visual.Water.Color", "x"]


def test_stage_and_saved_frame(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "k int, x double")
    S.write_stage(df, str(tmp_path / "s"), ("k",))
    assert {(r.k, r.x) for r in S.read_table(spark, str(tmp_path / "s")).collect()} == {(1, None), (2, 3.0)}


def test_secchi_rules(spark):
    acd = spark.createDataFrame([("ABC", 2010, 5, "SECCHI DEPTH", 4.0), ("ABC", 2011, 6, "SECCHI DEPTH", 6.0), ("ABC", 1999, 6, "SECCHI DEPTH", 60.0),
                                 ("ABC", 2010, None, "SECCHI DEPTH", 50.0), ("COM", 2010, 5, "SECCHI DEPTH", 1.0)],
                                "WATER string, YEAR int, MONTH int, METRIC string, VALUE_1 double")
    colours = spark.createDataFrame([("ABC", "spring", "Brown", 14.0)], "WATER string, season string, sechi_color string, FUI_num double")
    survey = spark.createDataFrame([("XYZ", "fall", 2.0, "light yellow"), ("XYZ", "spring", 3.0, "BROWN"), ("Q", "fall", None, "brown")],
                                   "WATER string, season string, sechi_depth double, sechi_color string")
    got = {tuple(r) for r in L.seasonal_secchi(acd, colours, survey).collect()}
    assert got == {("ABC.spring", "ABC", "spring", 5.0, 14.0), ("XYZ.fall", "XYZ", "fall", 2.0, 15.0), ("XYZ.spring", "XYZ", "spring", 3.0, 14.0),
                   ("HTL.fall", "HTL", "fall", 4.5, 15.0)}


def test_lake_table_recode_and_order(spark):
    rows = spark.createDataFrame([("MSL", "spring", 1.0), ("MSL", "fall", 2.0), ("COM", "fall", 3.0), ("COM", "fall", 3.0)], "WATER string, season string, v double")
    assert [tuple(r) for r in L.lake_table(rows).collect()] == [("Combs Lake", "Late", 3.0), ("Moss Lake", "Early", 1.0), ("Moss Lake", "Late", 2.0)]


def test_unknown_lakes(spark):
    a = spark.createDataFrame([("A",), ("B",)], "WATER string")
    assert [r.WATER for r in L.unknown_lakes(a, a.where("WATER = 'A'")).collect()] == ["B"]


def test_header_names(spark, tmp_path):
    assert S.dotted_names(["Sechi Depth (M)", "DOC", "DOC", "DOC.1", "DOC", "2nd", "_x", ".2", "if", "", "Größe µ", "ok_1.b"]) == [
        "Sechi.Depth..M.", "DOC", "DOC.2", "DOC.1", "DOC.3", "X2nd", "X_x", "X.2", "if.", "X", "Größe.µ", "ok_1.b"]
    (tmp_path / "in.csv").write_text('Visual Water Color (0.5M),DOC,DOC\n"a, b",1.5,NA\n,2,3\n')
    df = S.read_csv(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["Visual.Water.Color..0.5M.", "DOC", "DOC.1"] and [tuple(r) for r in df.collect()] == [("a, b", "1.5", None), (None, "2", "3")]
    with pytest.raises(ValueError, match="header"):
        S.read_csv(spark, str(tmp_path / "in.csv"), T.StructType([T.StructField(c, T.StringType()) for c in ("a", "DOC", "DOC.1")]))


def test_clean_up(spark):
    path = f"{application_folder(spark)}/kept"
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    clean_up(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
