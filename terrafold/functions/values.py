"""Which texts read as booleans, integers, numbers and timestamps, and the canonical text of values.

Invariant culture: surrounding white space is allowed, thousands separators are not, and only
``true``/``false`` in any case are booleans.  Built on ``try_cast`` so that no input raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _c

TYPES = ("Text", "Integer", "Long", "Double", "Boolean", "DateTime")
SPARK_TYPE = {"Text": "string", "Integer": "int", "Long": "bigint", "Double": "double", "Boolean": "boolean", "DateTime": "timestamp"}

DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss",
                "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSS][.SSSSSS][.SSS]XXX", "yyyy/MM/dd", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss")


def as_boolean(c) -> Column:
    t = F.lower(F.trim(_c(c)))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


# A failed cast costs far more than a failed pattern, so patterns come first.
_INT = r"^[+-]?[0-9]+$"
_REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def as_long(c) -> Column:
    t = F.trim(_c(c))
    return F.when(t.rlike(_INT), t.try_cast("bigint"))


def as_integer(c) -> Column:
    t = F.trim(_c(c))
    return F.when(t.rlike(_INT), t.try_cast("int"))


def as_double(c) -> Column:
    t = F.trim(_c(c))
    named = F.lower(t).isin("nan", "infinity", "-infinity", "+infinity")
    return F.when(t.rlike(_REAL), t.try_cast("double")).when(named, F.regexp_replace(F.lower(t), r"^\+", "").try_cast("double"))


def as_timestamp(c) -> Column:
    t = F.trim(_c(c))
    looks = t.rlike(r"^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}")
    return F.when(looks, F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]))


def leading_zero(c) -> Column:
    """A zero that carries meaning, as in a plot number: ``007`` but not ``0.7`` or ``0``."""
    c = _c(c)
    return F.startswith(c, F.lit("0")) & (F.length(c) > 1) & (F.substring(c, 2, 1) != ".")


def canonical_string(c, data_type: str) -> Column:
    """Null to empty text, booleans in lower case, timestamps in ISO form."""
    c = _c(c)
    if data_type == "Boolean":
        s = F.when(c, "true").otherwise("false")
    elif data_type == "DateTime":
        s = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0'XXX")
    elif data_type == "Double":
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        s = F.when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))
    else:
        s = c.cast("string")
    return F.when(c.isNull(), F.lit("")).otherwise(s)
