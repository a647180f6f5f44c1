"""Hashing, names, schema rules and keyed folds against plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from terrafold.functions import crs as C
from terrafold.functions.naming import NamingRules, bim_key, naming
from terrafold.operators import build as B
from terrafold.operators import classify as CL
from terrafold.operators import lexical as L
from terrafold.operators import schema as P
from terrafold.operators import scoring as S


def fnv(units):
    h = 2166136261
    for u in units:
        h = ((h ^ u) * 16777619) & 0xFFFFFFFF
    return h


def units(t):
    b = t.encode("utf-16-le")
    return [b[i] | b[i + 1] << 8 for i in range(0, len(b), 2)]


@pytest.mark.parametrize("text", ["C-ROAD 12", "Ünïté", "𝛼 road", ""])
def test_hash_vector_by_brute_force(text):
    flat = " " + "".join(c.lower() if c.isalnum() else " " for c in text) + " "
    u = units(flat)
    want = [0.0] * 64
    for g in (3, 4, 5):
        for i in range(len(u) - g + 1):
            h = fnv(u[i:i + g])
            want[h % 64] += 1 if h < 2**31 else -1
    size = math.sqrt(sum(v * v for v in want))
    idx, val = S.hash_vector(text, 64)
    got = [0.0] * 64
    for i, v in zip(idx, val):
        got[i] = float(v)
    assert got == pytest.approx([v / size if size else v for v in want], abs=1e-6)


def test_custom_code(spark):
    for t in ("PROJCS[x]", "𝛼é"):
        assert spark.range(1).select(C.custom_code(F.lit(t))).first()[0] == (fnv(units(t)) & 0x7FFFFFFF) | 1


def test_naming(spark):
    cases = {"Road / Centre--Line": "ROAD_CENTRE_LINE", "...": "LAYER".lower(), "été": "T", "a": "A"}
    d = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r[0]: r[1] for r in d.select("n", naming("n", NamingRules("Upper", "_", True))).collect()} == cases
    keys = {" Size (mm) ": "p_Size_mm", "__a__": "p_a", "///": None, "高度 x": "p_高度_x"}
    d = spark.createDataFrame([(k,) for k in keys], "n string")
    assert {r[0]: r[1] for r in d.select("n", bim_key("n", "p_")).collect()} == keys


@pytest.mark.parametrize("values,want", [
    (["0012", "0013"], "Text"), (["1", "-2", " 3 "], "Long"), (["1", "x"], "Text"), (["1.5", "2", "1e3"], "Double"), (["true", "False"], "Boolean"), (["1", "0"], "Long"),
    (["2024-01-01", "2024-02-03T10:00:00Z"], "DateTime"), (["", None], "Text"), (["0.5", "0"], "Double"), (["1,000"], "Text"),
])
def test_column_types(spark, values, want):
    d = spark.createDataFrame([("L", str(i), i, "F" if i else "f", v) for i, v in enumerate(values)], "layer string, element_id string, pos long, name string, value string")
    r = P.infer_schema(d).collect()
    assert len(r) == 1 and r[0]["data_type"] == want and r[0]["nullable"] == any(not v for v in values)


LEX = {"C-TOPO-CONTOUR": "Contour", "WATERMAIN": "Water Main", "ROAD": "Roads", "C-WTR-MAIN": "Water Main", "DOMAIN": "Unclassified", "SUN PATH": "Unclassified"}


def test_layer_names(spark):
    d = spark.createDataFrame([(k, k) for k in LEX], "subject_id string, name string").withColumn("metadata", F.create_map().cast("map<string,string>"))
    labels = ["Contour", "Water Main", "Roads", "Footpath"]
    got = {r["subject_id"]: r["label"] for r in L.classify_lexical(d, labels).collect()}
    assert got == LEX


def test_scores_for_priority_and_margin(spark):
    e = spark.createDataFrame([(1, {"Layer": "A", "Color": "1"})], "element_id int, attrs map<string,string>")
    e = e.withColumns({"native_type": F.lit("LINE"), "geometry_kind": F.lit("Line"), "text": F.lit(""), "area": F.lit(None).cast("double"), "length": F.lit(5.0)})
    lone, wide = CL.MappingRule("r1", "X", 10, layers=("a",)), CL.MappingRule("r2", "Y", 5, layers=("A",), colors=("1",), min_length=1.0)
    assert CL.decide(e, [lone]).first()["label"] == "X"
    # The higher priority is less certain than the runner-up: undecided.
    assert CL.decide(e, [lone, wide]).first()["label"] == "Unclassified"
    assert CL.decide(e, [lone, CL.MappingRule("r3", "Z", 1, layers=("A",))]).first()["provider"] == "Fallback"


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_failure_breaker_for_any_block(spark, block):
    import random

    rng = random.Random(5)
    rows = [(f"l{k}", i, rng.random() < 0.8) for k in range(4) for i in range(200)]
    want = set()
    for k in range(4):
        run = 0
        for _, i, bad in (r for r in rows if r[0] == f"l{k}"):
            run = run + 1 if bad else 0
            want.add((f"l{k}", i, run >= 12))
            if run >= 12:
                break
    d = spark.createDataFrame(rows, "layer string, pos long, failed boolean")
    got = {(r["layer"], r["pos"], r["abandoned"]) for r in B.failure_breaker(d, 12, block=block).collect()}
    assert got == want


def test_fallback_needs_another_provider(spark):
    d = spark.createDataFrame([], "batch_id int, subject_id string, label string")
    with pytest.raises(ValueError):
        S.with_fallback(d, d, d, "chat", "CHAT")


def test_separator_class_matches_every_separator():
    assert all(re.fullmatch(L._CLASS, c) for c in L.SEPARATORS)
