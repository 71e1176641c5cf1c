"""Secrets in texts: fixed patterns, and credentials whose parts lie in different places.

A string that could be an account's name, a random-looking string or an address is too weak a sign
alone. Here such candidates are joined within a scope with what complements them: an identifier with a
secret, and an endpoint with both. A scope is a block: it ends at a blank line, and where no part
follows within GAP code points. The join is one of intervals: of the complements of a scope, which
don't overlap each other by much, a part meets the one that begins last before it and the one that
begins first after it; that tells whether there is one, however many parts a scope has, and the
closer of the two is what it is reported with. Weak candidates without a complement are not reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.llm.common import small_batches, stored, table

REPLACEMENT = "[SECRET]"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Weak candidates; a group's span counts where there is one.
IDENTIFIER = re.compile(r"""(?:client|access|account|user|tenant|app)[_-]?(?:id|name|key[_-]?id)?["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{4,})""", re.I | re.A)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:(?<![a-z0-9+.-])[a-z][a-z0-9+.-]++://[A-Za-z0-9._~:@-]{4,}|(?<![A-Za-z0-9.-])[a-z0-9-]++(?:\.[a-z0-9-]++)+:[0-9]{2,5})")
#: Code points between a part's end and the next part's begin beyond which they belong to two blocks.
GAP = 2_000
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
#: In the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "pair_id", "pair_secret", "pair_endpoint")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; kind as its place in KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _mixed(s: str) -> bool:
    """Lower case, upper case and digits in one run: random rather than a word."""
    return any(c.islower() for c in s) and any(c.isupper() for c in s) and sum(c.isdigit() for c in s) >= 2


#: Of a random run's neighbours nearly half change as CHANGE says; of the names in a path few do.
CHANGE = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9])")
LEAST_CHANGES = 0.3


def _random(s: str) -> bool:
    """A mixed run that is no path: one with slashes has to change case and digits often between them."""
    return _mixed(s) and ("/" not in s or len(CHANGE.findall(s)) >= LEAST_CHANGES * (len(s) - 1 - 2 * s.count("/")))


def parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, bool, int, int, int]]:
    """(role, weak, scope, start, end) of what can be part of a credential."""
    found = [({0: "secret", 1: "id", 2: "secret"}[k], False, s, e) for s, k, e in base]
    weak = [("id", *m.span(1)) for m in IDENTIFIER.finditer(text)]
    weak += [("secret", *m.span()) for m in RANDOM.finditer(text) if _random(m[0])]
    weak += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))
    for role, s, e in weak:
        before = bisect_left(starts, e)
        if not before or ends[before - 1] <= s:
            found.append((role, True, s, e))
    if not any(w for _, w, _, _ in found):
        return []
    found.sort(key=lambda x: (x[2], x[3], x[0]))
    furthest = list(accumulate((e for _, _, _, e in found), max))
    breaks = [m.start() for m in BLANK_LINE.finditer(text)]
    breaks += [b for b, (_, _, s, _) in zip(furthest, found[1:], strict=False) if s - b > GAP]
    breaks.sort()
    return [(role, w, bisect_left(breaks, s), s, e) for role, w, s, e in found]


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_PART = pa.struct([("role", pa.string()), ("weak", pa.bool_()), ("scope", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SCANNED = "doc_id long, text_key string, base array<struct<start:int,kind:int,end:int>>, parts array<struct<role:string,weak:boolean,scope:int,start:int,end:int>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, bases, all_parts = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            own = parts(text, base)
            keys.append(hashlib.md5(text.encode("utf-8")).hexdigest() if base or own else None)
            bases.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in base])
            all_parts.append([dict(zip(("role", "weak", "scope", "start", "end"), x, strict=True)) for x in own])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(keys, pa.string()), pa.array(bases, pa.list_(_SPAN)), pa.array(all_parts, pa.list_(_PART))], names=["doc_id", "text_key", "base", "parts"])


#: What a part of each role has to meet in its scope to be reported.
COMPLEMENTS = {"id": ("secret",), "secret": ("id",), "endpoint": ("id", "secret")}
_AT = "struct<start:int,end:int>"
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _linked(parts_: DataFrame) -> DataFrame:
    """The weak rows of parts_ (doc_id, text_key, scope, role, weak, start, end) that meet their
    complements, with met: for each complement the nearest interval, the one before on ties."""
    scope = W.partitionBy("doc_id", "text_key", "scope").orderBy("start", "end", "role")
    before, after = scope.rowsBetween(W.unboundedPreceding, -1), scope.rowsBetween(1, W.unboundedFollowing)
    own = parts_
    for role in ("id", "secret"):
        at = F.when(F.col("role") == role, F.struct("start", "end"))
        own = own.withColumn(f"last_{role}", F.last(at, ignorenulls=True).over(before)).withColumn(f"next_{role}", F.first(at, ignorenulls=True).over(after))
    gap = lambda x: F.greatest(F.lit(0), x["start"] - F.col("end"), F.col("start") - x["end"])

    def nearest(role: str) -> Column:
        a, b = F.col(f"last_{role}"), F.col(f"next_{role}")
        return F.when(a.isNotNull() & (b.isNull() | (gap(a) <= gap(b))), a).otherwise(b).cast(_AT)

    met = F.lit(None).cast(f"array<{_AT}>")
    for role, others in COMPLEMENTS.items():
        met = F.when(F.col("role") == role, F.array(*[nearest(x) for x in others])).otherwise(met)
    own = own.where("weak").withColumn("met", met)
    return own.where(~F.exists("met", lambda x: x.isNull()))


def spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, spans (sorted array of start, kind, end), links.

    kind is a place in KINDS. links gives for each weak span the parts that it was reported for:
    an array of start, end and met, itself an array of start and end. text_key tells texts apart
    where a doc_id is null or repeated; it is null where nothing was found. A null text counts as
    empty. Spans are whole, however long. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = stored(docs.mapInArrow(_scanned, _SCANNED), "scanned")
    each = found.where(F.size("parts") > 0).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.explode("parts").alias("p")).select("doc_id", "text_key", "p.*")
    kind = F.element_at(F.create_map(*[F.lit(x) for r in ("id", "secret", "endpoint") for x in (r, KINDS.index(f"pair_{r}"))]), F.col("role"))
    linked = _linked(each).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", kind.alias("kind"), "end")).alias("linked"), F.sort_array(F.collect_set(F.struct("start", "end", "met"))).alias("links"))
    linked = linked.select(F.col("doc_id").alias("l_doc_id"), F.col("text_key").alias("l_text_key"), "linked", "links")
    out = found.join(linked, F.col("doc_id").eqNullSafe(F.col("l_doc_id")) & (F.col("text_key") == F.col("l_text_key")), "left")
    none = F.array().cast(_SPANS)
    return out.select("doc_id", "text_key", F.sort_array(F.concat("base", F.coalesce("linked", none))).alias("spans"), F.coalesce("links", F.array().cast(out.schema["links"].dataType)).alias("links"))


def _joined(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, with every span found replaced; text and n_chars change, nothing else.

    Spans that overlap are replaced as one. Texts without spans, null ones among them, stay as
    they are.
    """
    found = spans(docs).where(F.size("spans") > 0)
    # Merge overlapping spans: what is kept lies from the furthest end so far to the next start.
    folded = F.aggregate("spans", F.expr("named_struct('upto', 0, 'keep', cast(array() as array<struct<a:int,b:int>>))"), lambda acc, x: F.when(x["start"] >= acc["upto"], F.struct(x["end"].alias("upto"), F.concat(acc["keep"], F.array(F.struct(acc["upto"].alias("a"), x["start"].alias("b")))).alias("keep"))).otherwise(F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"), acc["keep"].alias("keep"))))
    cuts = stored(found.select(F.col("doc_id").alias("__cut_id"), F.col("text_key").alias("__cut_key"), folded.alias("__cut")).dropDuplicates(["__cut_id", "__cut_key"]), "cuts")
    at = F.col("doc_id").cast("long").eqNullSafe(F.col("__cut_id")) & F.md5(F.coalesce("text", F.lit("")).cast("binary")).eqNullSafe(F.col("__cut_key"))
    kept = F.transform(F.col("__cut.keep"), lambda k: F.substring(F.col("text"), k["a"] + 1, k["b"] - k["a"]))
    rest = F.substring(F.col("text"), F.col("__cut.upto") + 1, F.length("text"))
    text = F.array_join(F.concat(kept, F.array(rest)), REPLACEMENT)
    changed = F.col("__cut").isNotNull()
    out = docs.join(cuts, at, "left").withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    found = spans(table(spark, sf_dir, "documents"))
    place = lambda x: F.concat_ws(":", x["start"], x["end"])
    links = F.array_join(F.transform("links", lambda x: F.concat(place(x), F.lit(">"), F.array_join(F.transform(x["met"], place), "+"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] <= 2)
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), links.alias("links"))
