"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprint: 64 bits; a bit is 1 if it is set in over half of the XXH64 values
of the text's shingles (words in lower-case A-Z, repeats included).

Links join fingerprints at ``max_bits`` or fewer differing bits.  The 64 bits
are ``boxes`` segments on a ring.  If two fingerprints differ in at most t bits, there is
a start box from which every chain of l segments differs in at most l*t/boxes
bits (the pigeonring principle).  The leading segments have a budget of 0, so
they are equal; the following ones have a budget of 1, so one half of them is
equal too.  Those equal bits are the join key (40 bits for 8 segments and two
bits); the chain is then checked against its budgets and the whole
fingerprint against ``max_bits``.  Only distinct fingerprints are joined, so
copies cost one row.

Components: every linked fingerprint takes the smallest label of its
neighbours and of its label's label, round by round, until none changes.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and links like any other; equal rows share a component; a
null doc_id never names a component (null if all its members are null); a
text of any length is hashed a piece at a time; an empty table gives an empty
result.  Extra columns, whatever their names, pass through
``drop_near_duplicates``; ``near_duplicates`` does not read them.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh
from .textops import word_pieces

SHINGLE = 3
MAX_BITS = 2
BOXES = 8
SEED = 42
BITS = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text; counts are kept per piece."""
    ones, total, tail = np.zeros(BITS, dtype=np.int64), 0, []
    for words in word_pieces(text.lower()):  # bytes.lower: A-Z only
        words = tail + words
        if len(words) >= shingle:
            hashes = _shingle_hashes(words, shingle)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail = words[1 - shingle:] if shingle > 1 else []
    if not total:
        if not tail:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > total))


def _shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    values = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:].tolist())]
    return np.array(values, dtype="<u8")


def fingerprint_udf(shingle: int = SHINGLE):
    """Arrow UDF text -> fingerprint (as a signed long)."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        values = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return run


def _rotated(x: Column, bits: int) -> Column:
    if bits == 0:
        return x
    return F.shiftrightunsigned(x, bits).bitwiseOR(F.shiftleft(x, BITS - bits))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def ring_masks(boxes: int, max_bits: int) -> tuple[list[int], int]:
    """Masks of the segments that must be equal, counted from the start box,
    and the mask of the chain whose budget is 1."""
    width = BITS // boxes
    exact = max(n for n in range(boxes + 1) if n * max_bits < boxes or max_bits == 0)
    loose = max(n for n in range(boxes + 1) if n * max_bits < 2 * boxes)
    span = lambda a, b: ((1 << (b - a) * width) - 1) << (a * width)
    half = (exact + loose + 1) // 2
    if loose - exact < 2:
        return [span(0, exact)], span(0, loose)
    return [span(0, half), span(0, exact) | span(half, loose)], span(0, loose)


def links(prints: DataFrame, max_bits: int = MAX_BITS, boxes: int = BOXES) -> DataFrame:
    """Distinct pairs (a, b), a < b, of linked values of the column ``fp``
    (distinct longs)."""
    masks, chain = ring_masks(boxes, max_bits)
    width = BITS // boxes
    keys = []
    for start in range(boxes):
        for half, mask in enumerate(masks):
            keys.append(F.struct(F.lit(start * len(masks) + half).alias("slot"),
                                 _rotated(F.col("fp"), start * width).bitwiseAND(F.lit(_signed(mask))).alias("key")))
    probes = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.slot", "k.key")
    a, b = probes.alias("a"), probes.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    chains = F.array(*[F.lit(_signed(_rotate_int(chain, s * width))) for s in range(boxes) for _ in masks])
    in_budget = F.bit_count(differ.bitwiseAND(F.get(chains, F.col("a.slot")))) <= 1
    on = ((F.col("a.key") == F.col("b.key")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.fp") < F.col("b.fp"))
          & in_budget & (F.bit_count(differ) <= max_bits))
    return a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def _rotate_int(mask: int, bits: int) -> int:
    """The mask, given from its start box, in the fingerprint's own places."""
    return ((mask << bits) | (mask >> (BITS - bits))) & ((1 << BITS) - 1) if bits else mask


def components(pairs: DataFrame) -> DataFrame:
    """(fp, label): for every linked fingerprint the smallest of its component."""
    edges = cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(edges.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("label"))
                      .select("fp", F.least("fp", "label").alias("label"), F.lit(True).alias("changed")))
    while labels.where("changed").limit(1).count():
        seen = labels.select("fp", "label")
        far = edges.join(seen.withColumnRenamed("fp", "a"), "a").select(F.col("b").alias("fp"), "label")
        hooked = far.join(seen.withColumnRenamed("label", "root"), "fp").select(F.col("root").alias("fp"), "label")
        low = far.union(hooked).union(seen).groupBy("fp").agg(F.min("label").alias("label"))
        jump = low.select(F.col("fp").alias("label"), F.col("label").alias("next"))
        moved = low.join(jump, "label").select("fp", F.col("next").alias("label"))
        labels = cut(moved.join(seen.withColumnRenamed("label", "old"), "fp")
                          .select("fp", "label", (F.col("label") != F.col("old")).alias("changed")))
    return labels.select("fp", "label")


def component_table(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, label, component_id) per distinct fingerprint of rows (doc_id, fp)."""
    per = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(per.select("fp"), max_bits))
    named = per.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    linked = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return named.join(linked, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) per row of documents (doc_id, text)."""
    prints = cut(docs.select("doc_id", fingerprint_udf(shingle)("text").alias("fp")))
    return prints.join(component_table(prints, max_bits), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one with
    the smallest doc_id (nulls last), then fingerprint; of rows equal in both
    any one.  ``row`` numbers the rows of the written table."""
    names = dict(zip(docs.columns, fresh(docs, *[f"__c{i}" for i in range(len(docs.columns))])))
    rows = docs.withColumnsRenamed(names)
    rows = cut(rows.select("*", fingerprint_udf(shingle)(names["text"]).alias("fp"),
                           F.monotonically_increasing_id().alias("row")))
    prints = rows.select("row", "fp", F.col(names["doc_id"]).alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "row")).alias("first")
    keep = prints.join(component_table(prints, max_bits), "fp").groupBy("label").agg(first).select("first.row")
    return rows.join(keep, "row", "left_semi").select(*[F.col(n).alias(c) for c, n in names.items()])
