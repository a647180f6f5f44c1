"""Output names for layers and fields, and attribute keys for BIM parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _c

FALLBACK = "layer"


@dataclass(frozen=True)
class NamingRules:
    case: str = "Preserve"
    separator: str = "_"
    ascii_only: bool = False
    prefix: str = ""
    max_field: int = 0
    max_layer: int = 0


def naming(c, rules: NamingRules, max_length: int = 0) -> Column:
    """Prefix, replace characters outside the allowed set, collapse and trim separators, case, cap."""
    t = F.concat(F.lit(rules.prefix), F.trim(_c(c)))
    allowed = "A-Za-z0-9_" if rules.ascii_only else r"\p{L}\p{Nd}_"
    sep = rules.separator
    t = F.regexp_replace(t, f"[^{allowed}]", sep.replace("\\", "\\\\").replace("$", "\\$"))
    if sep:
        esc = re.escape(sep)
        t = F.regexp_replace(t, f"(?:{esc})+", sep.replace("\\", "\\\\").replace("$", "\\$"))
        edge = re.escape(sep[0])
        t = F.regexp_replace(t, f"^{edge}+|{edge}+$", "")
    t = {"Upper": F.upper, "Lower": F.lower}.get(rules.case, lambda v: v)(t)
    t = F.when(F.length(t) == 0, F.lit(FALLBACK)).otherwise(t)
    cap = max_length or rules.max_layer
    return F.substring(t, 1, cap) if cap > 0 else t


def field_name(c, rules: NamingRules) -> Column:
    return naming(c, rules, rules.max_field)


def bim_key(c, prefix: str) -> Column:
    """Parameter key: runs outside letters, digits and underscore become one underscore; null if nothing is left."""
    t = F.regexp_replace(_c(c), r"^[^\p{L}\p{Nd}_]+", "")
    t = F.regexp_replace(t, r"_[^\p{L}\p{Nd}_]+", "_")
    t = F.regexp_replace(t, r"[^\p{L}\p{Nd}_]+", "_")
    t = F.regexp_replace(t, r"^_+|_+$", "")
    return F.when(F.length(t) > 0, F.concat(F.lit(prefix), t))


def bim_truncate(c, limit: int = 512) -> Column:
    c = _c(c)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 3), F.lit("...")))


def safe_file_name(c) -> Column:
    """File name of a feature class: characters no file system takes, dots and blanks become underscores."""
    t = F.regexp_replace(_c(c), r'[\x00-\x1f<>:"/\\|?*. ]', "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.when(F.length(t) > 0, t).otherwise(F.lit(FALLBACK))
