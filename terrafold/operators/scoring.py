"""Subject texts, hashed features, model scores, prompts, answers, cache keys and provider fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .classify import confidence
from .common import dense_position, spread

KIND_ORDER = ("Unknown", "Point", "Line", "Polygon", "Annotation")  # fixed values


def describe(max_items: int = 5, max_text: int = 40) -> Column:
    """One line per subject: name, geometry, count, mix, blocks, texts, then metadata by key."""
    def listing(label, col, cut):
        clean = F.transform(F.slice(col, 1, max_items), lambda v: F.trim(F.translate(v, "\n\r", "  ")))
        clean = F.transform(clean, lambda v: F.substring(v, 1, cut)) if cut else clean
        more = F.when(F.size(col) > max_items, F.concat(F.lit("|+"), (F.size(col) - max_items).cast("string"))).otherwise("")
        return F.when(F.size(col) > 0, F.concat(F.lit(f"; {label}=["), F.array_join(clean, "|"), more, F.lit("]"))).otherwise("")

    kinds = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.try_element_at("geometry_profile", F.lit(k)).alias("n")) for k in KIND_ORDER]), lambda e: e["n"].isNotNull())
    mix = F.when(F.size("geometry_profile") > 1, F.concat(F.lit("; mix="), F.array_join(F.transform(kinds, lambda e: F.concat(e["k"], F.lit(":"), e["n"].cast("string"))), ","))).otherwise("")
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(F.lit("; "), e["key"], F.lit("="), e["value"])), "")
    return F.concat(F.lit("name="), F.col("name"), F.lit("; geometry="), F.col("dominant_geometry"), F.lit("; entities="), F.col("entity_count").cast("string"),
                    mix, listing("blocks", "block_names", None), listing("text", "sample_texts", max_text), meta)


def describe_subjects(subjects: DataFrame) -> DataFrame:
    return subjects.withColumn("descriptor", describe())


# Fixed values of the 32-bit hash.
BASIS, PRIME = np.uint32(2166136261), np.uint32(16777619)


#: Vectors of texts that a task keeps.
KEPT_TEXTS = 4096


def hash_vector(text: str, dim: int, lo: int = 3, hi: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero buckets and values of the signed, length-one n-gram vector of a text."""
    flat = "".join(c.lower() if c.isalnum() and len(c.lower()) == 1 else c if c.isalnum() else " " for c in text)
    units = np.frombuffer((" " + flat + " ").encode("utf-16-le"), dtype="<u2").astype(np.uint32)
    vec = np.zeros(dim, np.float32)
    with np.errstate(over="ignore"):
        for g in range(lo, hi + 1):
            n = len(units) - g + 1
            if n < 1:
                continue
            h = np.full(n, BASIS, np.uint32)
            for k in range(g):
                h = (h ^ units[k:k + n]) * PRIME
            np.add.at(vec, (h % np.uint32(dim)).astype(np.int64), np.where(h & np.uint32(0x80000000), np.float32(-1), np.float32(1)))
    size = np.float32(np.sqrt((vec.astype(np.float64) ** 2).sum()))
    idx = np.flatnonzero(vec)
    return idx, vec[idx] / size if size > 0 else vec[idx]


def hash_features(subjects: DataFrame, dim: int = 512, text: str = "descriptor") -> DataFrame:
    """Sparse features ``subject_id, bucket, value``, row by row: no vector is sorted or sent.

    A task keeps the vectors of the texts it met last, so that repeated texts are hashed once.
    """
    pair = T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("value", T.FloatType())]))

    @F.arrow_udf(pair)
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = lru_cache(KEPT_TEXTS)(lambda t: hash_vector(t, dim))
        for part in parts:
            found = [known(t or "") for t in part.to_pylist()]
            ends = np.cumsum([0, *(len(i) for i, _ in found)]).astype(np.int32)
            flat = lambda n, kind: pa.array(np.concatenate([np.zeros(0, kind), *(f[n] for f in found)]).astype(kind))
            rows = pa.StructArray.from_arrays([flat(0, np.int32), flat(1, np.float32)], names=["bucket", "value"])
            yield pa.ListArray.from_arrays(pa.array(ends), rows)

    return spread(subjects.select("subject_id", F.col(text).alias("_t"))).select("subject_id", F.explode(encode("_t")).alias("f")).select("subject_id", "f.*")


def softmax_scores(logits: DataFrame, labels: list[str], candidates: list[str], top: int = 4, unknown: str = "Unclassified") -> DataFrame:
    """Best label and three alternatives from ``subject_id, logits`` (array in model label order).

    Only candidate labels count; with none in common every subject is unknown.  Row-local, no shuffle.
    """
    allowed = {c.lower() for c in candidates}
    keep = [(i, name) for i, name in enumerate(labels) if name.lower() in allowed]
    none = F.array().cast("array<struct<label:string,confidence:double>>")
    if not keep:
        return logits.select("subject_id", F.lit(unknown).alias("label"), F.lit(0.0).alias("confidence"), none.alias("alternatives"))
    s = F.filter(F.array(*[F.struct(F.lit(name).alias("label"), F.get("logits", F.lit(i)).cast("double").alias("z")) for i, name in keep]), lambda e: e["z"].isNotNull())
    top_z = lambda a: F.array_max(F.transform(a, lambda e: e["z"]))
    exps = lambda a: F.transform(a, lambda e: F.struct(e["label"].alias("label"), F.exp(e["z"] - top_z(a)).alias("x")))

    def share(a):
        total = F.aggregate(F.transform(a, lambda e: e["x"]), F.lit(0.0), lambda u, v: u + v)
        return F.transform(a, lambda e: F.struct(e["label"].alias("label"), (e["x"] / total).alias("confidence")))

    from ..functions.geometry import let

    ranked = F.array_sort(let(let(s, exps), share), lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).when(
        a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))
    d = logits.select("subject_id", ranked.alias("_r"))
    best = F.get("_r", F.lit(0))
    return d.select("subject_id", F.coalesce(best["label"], F.lit(unknown)).alias("label"), confidence(best["confidence"]).alias("confidence"), F.slice("_r", 2, top - 1).alias("alternatives"))


def linear_model(weights: np.ndarray, bias: np.ndarray) -> Callable:
    """Scorer of dense batches by a weight matrix; stands where no model file is given."""
    return lambda x: x @ weights + bias


def model_logits(subjects: DataFrame, load: Callable[[], Callable], dim: int = 512, text: str = "descriptor") -> DataFrame:
    """``subject_id, logits`` of each subject; ``load`` runs once per task and returns the scorer."""
    def score(batches):
        model = load()
        for s in batches:
            x = np.zeros((len(s), dim), np.float32)
            for r, t in enumerate(s):
                i, v = hash_vector(t or "", dim)
                x[r, i] = v
            yield pd.Series(list(np.asarray(model(x), dtype=np.float64)))

    udf = F.pandas_udf(score, "array<double>", F.PandasUDFType.SCALAR_ITER)
    return subjects.select("subject_id", udf(F.col(text)).alias("logits"))


def cache_key(provider: str, domain: str, units: str, unknown: str, labels: list[str], entries: Column) -> Column:
    """Provider and digest over context, labels and the ordered ``id=descriptor`` entries of a request."""
    sep = "\x1f"
    head = sep.join([provider, domain, units, unknown, *labels]) + sep
    body = F.concat(F.lit(head), F.array_join(F.transform(entries, lambda e: F.concat(e, F.lit(sep))), ""))
    return F.concat(F.lit(provider + ":"), F.sha2(body, 256))


def chunked(subjects: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Add ``chunk``: consecutive groups of ``size`` subjects by position, without one global sort."""
    return dense_position(subjects, pos, "_i").withColumn("chunk", F.floor(F.col("_i") / max(1, size)).cast("long")).drop("_i")


def prompt_batches(subjects: DataFrame, labels: list[str], size: int, domain: str = "", units: str = "", unknown: str = "Unclassified") -> DataFrame:
    """``chunk, system, user, entries``: one request text per chunk of subjects with a ``descriptor``."""
    system = "\n".join([
        "Classify each CAD layer below into one GIS feature class.", f'Use only the allowed labels; answer "{unknown}" when none fits.',
        "Keep the geometry in mind and expand usual abbreviations.", "confidence is a probability from 0 to 1.",
        'Answer with JSON only: {"results":[{"id":"","label":"","confidence":0,"rationale":"","alternatives":[{"label":"","confidence":0}]}]}'])
    head = [f"PROJECT DOMAIN: {domain}"] * bool(domain.strip()) + [f"DRAWING UNITS: {units}"] * bool(units.strip()) + ["ALLOWED LABELS:"] + [f"- {v}" for v in labels] + ["", "LAYERS TO CLASSIFY:"]
    d = chunked(subjects, size).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "subject_id", "descriptor"))).alias("_s"))
    lines = F.transform("_s", lambda s: F.concat(F.lit("- id="), s["subject_id"], F.lit(" | "), s["descriptor"]))
    entries = F.transform("_s", lambda s: F.concat(s["subject_id"], F.lit("="), s["descriptor"]))
    return d.select("chunk", F.lit(system).alias("system"), F.concat(F.lit("\n".join(head) + "\n"), F.array_join(lines, "\n")).alias("user"), entries.alias("entries"))


ANSWER = "struct<results:array<struct<id:string,label:string,confidence:string,rationale:string,alternatives:array<struct<label:string,confidence:string>>>>>"


def _score(c: Column) -> Column:
    from ..functions.values import as_double

    v = as_double(c)
    v = F.when((v > 1) & (v <= 100), v / 100).otherwise(v)
    return confidence(v)


def parse_answers(raw: DataFrame, subjects: DataFrame, labels: list[str], unknown: str = "Unclassified") -> DataFrame:
    """``subject_id, label, confidence, rationale, alternatives, pos`` from model texts (``pos, content``).

    The JSON object between the first and last brace is read; entries of unknown ids are dropped, labels
    outside the candidates are unknown, percentages become fractions.
    """
    text = F.regexp_extract("content", r"(?s)(\{.*\})", 1)
    a = raw.select("pos", F.from_json(text, ANSWER).alias("a")).select("pos", F.posexplode("a.results").alias("_i", "r"))
    allowed = [v.lower() for v in labels]
    ok = F.lower(F.trim("r.label")).isin(*allowed)
    alts = F.transform(F.filter(F.coalesce("r.alternatives", F.array()), lambda e: F.coalesce(F.lower(e["label"]).isin(*allowed), F.lit(False))),
                       lambda e: F.struct(e["label"].alias("label"), _score(e["confidence"]).alias("confidence")))
    d = a.select(F.col("r.id").alias("subject_id"), F.when(ok, F.trim("r.label")).otherwise(unknown).alias("label"), _score(F.col("r.confidence")).alias("confidence"),
                 F.col("r.rationale").alias("rationale"), alts.alias("alternatives"), F.struct("pos", "_i").alias("pos"))
    known = subjects.select(F.lower("subject_id").alias("_k")).distinct()
    return d.withColumn("_k", F.lower("subject_id")).join(known, "_k", "left_semi").drop("_k")


def with_fallback(primary: DataFrame, fallback: DataFrame, batches: DataFrame, primary_key: str, fallback_key: str) -> DataFrame:
    """Primary answers of batches that succeeded, the fallback's for the others.

    ``batches`` carries ``batch_id, ok``; both answer tables carry ``batch_id``.  A provider cannot back
    itself up.
    """
    if primary_key.lower() == fallback_key.lower():
        raise ValueError("the fallback must be another provider")
    good = batches.where("ok").select("batch_id")
    bad = batches.where("NOT ok").select("batch_id")
    a = primary.join(good, "batch_id", "left_semi").withColumn("provider", F.lit(primary_key))
    return a.unionByName(fallback.join(bad, "batch_id", "left_semi").withColumn("provider", F.lit(fallback_key)))


def cached_requests(requests: DataFrame, ttl_minutes: float = 240.0) -> DataFrame:
    """Mark each request (``key, at``) as ``hit`` or the call that fills the cache for ``ttl_minutes``.

    A call is made when no unexpired entry exists, and its time then starts the next entry.  Keys spread
    over tasks; a task reads its sorted rows in batches and holds one expiry time, whatever a key's size.
    """
    ttl = pd.Timedelta(minutes=ttl_minutes)
    schema = T.StructType([*requests.schema.fields, T.StructField("hit", T.BooleanType())])

    def fold(batches):
        current, until = None, None
        for pdf in batches:
            hits = []
            for key, t in zip(pdf["key"], pdf["at"]):
                if key != current:
                    current, until = key, None
                hit = until is not None and t < until
                if not hit:
                    until = t + ttl
                hits.append(hit)
            yield pdf.assign(hit=hits)

    return requests.repartition("key").sortWithinPartitions("key", "at", "seq").mapInPandas(fold, schema)
