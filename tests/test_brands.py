"""Brands by a join against brands as constants."""

from pyspark.sql import functions as F

from terrane.functions import refdata
from terrane.operators import normalize

NAMES = ["Highlands Coffee", "highlands coffee hồ gươm", "Phở 24", "Circle K 12", "CIRCLE-K", "Quán A", "", None, "The Coffee House", "Coffee House", "Co.opmart Quận 1", "KFC", "VinMart+ Hà Nội", "coffee", "House The Coffee", "Vincom Plaza", "Vietcombank ATM", "Highlands Coffee"]


def test_join_equals_constants(spark):
    table = refdata.brands(spark)
    known = normalize.brand_rows(table)
    aliases = [a for n, al, _ in known for a in (n, *al)]
    names = spark.createDataFrame([(i, n) for i, n in enumerate([*NAMES, *aliases, *[f"shop {a} x" for a in aliases]])], "i long, name string")
    want = {r.i: r.b for r in names.select("i", normalize.detect_brand(F.col("name"), known).alias("b")).collect()}
    got = {r.i: r.b for r in normalize.join_brands(names, table, out="b").collect()}
    assert got == want and len({b.brand for b in got.values()}) > 20
    assert normalize.join_brands(names.limit(0), table).count() == 0


def test_more_brands_than_constants(spark):
    table = spark.range(6000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("brand n"), "id").alias("name"), F.array(F.concat(F.lit("alias n"), "id")).alias("aliases"), F.lit(None).cast("string").alias("match_pattern"), (F.col("id") != 7).alias("enabled"))
    names = spark.createDataFrame([("the brand n5999 shop",), ("Alias N12",), ("brand n7",), ("brand n6000",), ("n3 and n4 brand",)], "name string")
    got = {r.name: (r.b.brand, r.b.confidence) for r in normalize.join_brands(names, table, out="b").collect()}
    assert got == {"the brand n5999 shop": ("brand n5999", 0.75), "Alias N12": ("brand n12", 0.9), "brand n7": (None, None), "brand n6000": (None, None), "n3 and n4 brand": ("brand n3", 0.75)}
