from pyspark.sql import functions as F

from tallyline.functions import persons


def test_lists_are_whole():
    assert len(persons.GIVEN_NAMES) == 102 and sum(map(len, persons.GIVEN_NAMES)) == 162 and len({n for g in persons.GIVEN_NAMES for n in g}) == 162
    assert len(persons.BUSINESS_PATTERNS) == len(set(persons.BUSINESS_PATTERNS)) == 75


def test_names_once_lost(spark):
    rows = spark.createDataFrame([("Vila Puig Eduard",), ("Vila Puig Hugo",), ("Mantenimiento Vila",), ("Instal·lacions Pou",), ("Vila Pou",)], "n string")
    got = [tuple(r) for r in rows.select(persons.split_name(F.col("n"))["given"], persons.looks_like_business(F.col("n"))).collect()]
    assert got[0] == ("EDUARD", False) and got[1] == ("HUGO", False) and got[2][1] and got[3][1] and not got[4][1]
