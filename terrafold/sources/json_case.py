"""JSON objects whose keys start in lower or upper case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import _c


def _upper(schema: str) -> str:
    """The same DDL with every field name capitalised; names that start with an underscore stay."""
    return re.sub(r"([A-Za-z]\w*)(\s*:)", lambda m: m.group(1)[0].upper() + m.group(1)[1:] + m.group(2), schema)


def either_case(text, schema: str, marker: str) -> Column:
    """Struct of ``schema`` read with lower- or upper-case key starts, whichever yields ``marker``."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    low, up = F.from_json(_c(text), schema, opts), F.from_json(_c(text), _upper(schema), opts)
    return F.when(low[marker].isNotNull(), low).otherwise(up.cast(schema))
