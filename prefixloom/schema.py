"""Schemas of the library's tables.  Rows have no order of their own, so `cat_ord` and `ord` carry it."""

from pyspark.sql import types as T

ATTR = T.StructType().add("k", "string").add("b", "boolean").add("i", "long")

CATEGORIES = (
    T.StructType().add("file", "string").add("kind", "string").add("cat_ord", "integer").add("name", "string").add("reverse", "boolean")
)
GEOIP = (
    T.StructType().add("file", "string").add("cat_ord", "integer").add("cat", "string").add("ord", "long")
    .add("fam", "byte").add("pfx", "short").add("ip", "binary")
)
GEOSITE = (
    T.StructType().add("file", "string").add("cat_ord", "integer").add("cat", "string").add("ord", "long")
    .add("type", "short").add("val", "string").add("attrs", T.ArrayType(ATTR))
)

#: Fixed values of the rule format: the type numbers and their text prefixes.
TYPE_NAMES = {0: "keyword", 1: "regexp", 2: "domain", 3: "full"}
TYPE_NUMBERS = {"keyword": 0, "regexp": 1, "regex": 1, "domain": 2, "full": 3}
KEYWORD, REGEXP, DOMAIN, FULL = 0, 1, 2, 3
