"""Check digits, national codes, classification and specification signatures, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specmint import dictionaries as D


def damm(digits: Column) -> Column:
    """Check digit of a digit string; null when it holds anything else."""
    table = F.array(*(F.lit(v) for row in D.DAMM for v in row))
    folded = F.aggregate(F.filter(F.split(digits, ""), lambda d: d != ""), F.lit(0), lambda state, d: F.get(table, state * 10 + d.cast("int")))
    return F.when(digits.rlike(r"^\d*$"), folded)


def damm_valid(digits: Column) -> Column:
    return F.coalesce(damm(digits) == 0, F.lit(False))


def mint(class_code: Column, serial: Column) -> Column:
    """The code of a class (ss.ff.cc) and a serial; null when either is out of form."""
    body = F.concat(F.replace(class_code, F.lit("."), F.lit("")), F.lpad(serial.cast("string"), D.SERIAL_DIGITS, "0"))
    code = F.concat_ws("-", F.lit(D.CODE_PREFIX), F.replace(class_code, F.lit("."), F.lit("-")), F.lpad(serial.cast("string"), D.SERIAL_DIGITS, "0"), damm(body).cast("string"))
    return F.when(class_code.rlike(r"^\d\d\.\d\d\.\d\d$") & serial.between(0, 10**D.SERIAL_DIGITS - 1), code)


def parse(code: Column) -> Column:
    """struct(class_code, serial, check, valid); null when the text hasn't the form of a code."""
    c = F.upper(F.trim(code))
    form = rf"^{D.CODE_PREFIX}-(\d\d)-(\d\d)-(\d\d)-(\d{{{D.SERIAL_DIGITS}}})-(\d)$"
    part = lambda i: F.regexp_extract(c, form, i)
    parsed = F.struct(
        F.concat_ws(".", part(1), part(2), part(3)).alias("class_code"),
        part(4).try_cast("int").alias("serial"),
        part(5).try_cast("int").alias("check"),
        damm_valid(F.concat(*(part(i) for i in range(1, 6)))).alias("valid"),
    )
    return F.when(c.rlike(form), parsed)


def class_of(category: Column) -> Column:
    classes = F.create_map(*(F.lit(x) for c in D.CLASSES for x in (c[4], c[0])))
    return F.coalesce(F.try_element_at(classes, F.coalesce(category, F.lit(""))), F.lit(D.UNCLASSIFIED[0]))


def defining_keys(class_code: Column) -> Column:
    keys = F.create_map(*(x for c in D.CLASSES for x in (F.lit(c[0]), F.array(*(F.lit(k) for k in c[5])))))
    return F.coalesce(F.try_element_at(keys, class_code), F.array().cast("array<string>"))


def signature(class_code: Column, attrs: Column) -> Column:
    """k=v of the class's defining keys in its order, ? where unread; '' for an unclassified item."""
    return F.array_join(F.transform(defining_keys(class_code), lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at(attrs, k), F.lit("?")))), "|")


def signature_complete(class_code: Column, attrs: Column) -> Column:
    keys = defining_keys(class_code)
    return (F.size(keys) > 0) & F.forall(keys, lambda k: F.map_contains_key(attrs, k))


def support(class_code: Column, attrs: Column, wanted: Column, least: int = 2) -> Column:
    """conflict, confirmed, provisional or unsupported: how far a record bears out a code's signature."""
    want = F.when(F.coalesce(wanted, F.lit("")) == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(wanted, F.lit(r"\|"), F.lit("=")))
    keys = defining_keys(class_code)

    def state(k: Column) -> Column:
        expected, have = F.coalesce(F.try_element_at(want, k), F.lit("?")), F.try_element_at(attrs, k)
        return F.when(have.isNull() | (expected == "?"), F.lit("u")).when(have == expected, F.lit("m")).otherwise(F.lit("c"))

    states = F.transform(keys, state)
    matched = F.size(F.filter(states, lambda s: s == "m"))
    return (
        F.when(F.array_contains(states, "c"), "conflict")
        .when((F.size(keys) > 0) & ~F.array_contains(states, "u"), "confirmed")
        .when(matched >= least, "provisional")
        .otherwise("unsupported")
    )
