import pytest
from pyspark.sql import functions as F

from wakeline.functions import destination as D

#: Texts and what cleaning makes of them.
CLEAN = [
    ("CN > FOC", "cnfoc"),
    ("JP> TRG", "jptrg"),
    ("ITRAN>TRYLA", "tryla"),
    ("ZONA_PESCA>==", "zona pesca"),
    ("FR MRS > TN LGN", "tn lgn"),
    (">JP TYO H", "jp tyo h"),
    ("XXX <UAE>", "xxx uae"),
    ("GB MID-L", "gb mid l"),
    ("NL TNZ", "nl tnz"),
    ("RUULU>INPPT", "inppt"),
    ("US^08XG>0902", "0902"),
    ("", ""),
    (None, None),
    ('A VERY LONG DESTINATION TEXT HERE" REST', "a very long destination text here"),
    ('B"' + "C" * 28, "b " + "c" * 28),
    ("ÉÜ -Ñ@|", "éü ñ@|"),
    ("a\\b\r\nc", "a b c"),
    (">>", ""),
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def results(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_clean(spark):
    assert results(column(spark, [a for a, _ in CLEAN]), D.clean_destination(F.col("x"))) == [b for _, b in CLEAN]


def test_valid(spark):
    df = column(spark, [None, "", "ab", "a b", "abc", "..", "CN > FO"])
    assert results(df, D.is_valid_destination(F.col("x"))) == [False, False, False, True, True, False, False]


def test_noise(spark):
    df = column(spark, ["for orders", "open sea", "armed guards on board", "busan", "busan for order", "pacific ocean", "", "orderorderorder", "drifting for schedule"])
    assert results(df, D.noise_full(F.col("x"))) == [True, True, True, False, False, True, True, True, True]
    assert results(df.filter("x like 'busan%'"), D.noise_part(F.col("x"))) == [False, True]


def test_numeric_and_words(spark):
    df = column(spark, ["0902", "1e5", "nan", "inf", "12a", "12 3", ""])
    assert results(df, D.is_numeric_text(F.col("x"))) == [True, True, True, True, False, False, False]
    assert results(column(spark, ["a b", "a", " a b ", ""]), D.last_word(F.col("x"))) == ["b", "a", "b", ""]


def test_candidates(spark):
    df = column(spark, ["shacn", "cn sha", "sha cn", "abcd efg", "eta to cnsha", "abc"])
    assert results(df, D.code_candidates(F.col("x"))) == [["cnsha", "shacn"], ["cnsha"], ["cnsha"], [], ["cnsha", "to", "eta"], ["abc"]]


@pytest.mark.parametrize("code,group", [("GRPIR", "gr_ro_bg_cy_mt"), ("FJSUV", "au_nz_pg_fj"), ("EETLL", "de_pl_ru_fi_lv_lt_ee"), ("KRPUS", None), ("GR", None), ("", None), (None, None)])
def test_country_group(spark, code, group):
    assert results(column(spark, [code]), D.country_group(F.col("x"))) == [group]
