r"""SimHash near-dedup by deletion-variant signatures.

Fingerprints of 64 bits link at three differing bits or fewer. Cut into two halves, one
half of a linked pair differs by one bit at most; so both have an equal signature: the half
with one bit left out. Each distinct fingerprint is indexed under its 64 signatures, an
equality join brings candidates together, and the join's condition verifies them. A pair
is taken only under the first signature that it shares. Signatures that very many
fingerprints share are cut again: given the shared half, the other half differs by three
bits at most, so one of its two quarters differs by one bit at most, which gives 32 finer
signatures a fingerprint. Copies share a fingerprint and are never paired.

Words are the runs of ``[^\x20\x09-\x0D]`` of the text with A-Z lower-cased. A null or blank
text has fingerprint zero, which links like any other. Rows link by their texts only: null
ids and shared ids don't. A component's id is its least id that isn't null. Repeated rows are
copies. Other columns are not read. An empty table gives no rows. The pipeline's stage has a
rule of its own (see ``near_copies``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm.common import documents, stored
from lexispan.llm.components import least_labels
from lexispan.llm.near_copies import one_of_each, shingle_hashes  # noqa: F401  the stage's rule is its own

SHINGLE = 3
MAX_BITS = 3
#: Fingerprints under one signature beyond which it is cut again.
CROWD = 256

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.array(hashes[k : k + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(x.as_py()) for x in batch["text"]], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(values)], names=["node", "fp"])


def _differing(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def _signatures() -> Column:
    """Which bit is left out (0-63) above the half that it is left out of, in one long each; of a column named fp."""
    return F.expr(
        "transform(sequence(0, 63), j -> shiftleft(cast(j as bigint), 32) | "
        "(if(j < 32, fp & 4294967295, shiftrightunsigned(fp, 32)) & ~shiftleft(1L, j % 32)))"
    )


def _first_shared(x: str, y: str) -> str:
    """The left-out bit of the first signature that two fingerprints share, in SQL: of the lower half if that
    differs by a bit at most (bit 0 if it is equal), else of the upper half."""
    xor = f"({x} ^ {y})"
    low, high = f"({xor} & 4294967295)", f"shiftrightunsigned({xor}, 32)"
    place = lambda v: f"greatest(0, bit_count({v} - 1))"  # noqa: E731  of a single bit; the value may be zero
    return (
        f"case when {low} = 0 then 0 when bit_count({low}) = 1 then {place(low)} "
        f"when {high} = 0 then 32 else 32 + {place(high)} end"
    )


def near_links(prints: DataFrame, label: str = "simhash") -> DataFrame:
    """a, b: nodes whose fingerprints differ by three bits or fewer. ``prints``: distinct fp, node."""
    keyed = stored(prints.select("fp", "node", F.explode(_signatures()).alias("key")), f"{label}-keys")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(keyed.join(counts, "key"), f"{label}-met")
    usual = met.where(F.col("n") <= CROWD).select("fp", "node", "key", F.lit(0).alias("finer"))
    # the other half of the fingerprint, cut into quarters: (quarter, bit left out, rest)
    finer = F.expr(
        "transform(sequence(0, 31), q -> shiftleft(q, 16) | cast(shiftrightunsigned("
        "if(shiftrightunsigned(key, 32) < 32, shiftrightunsigned(fp, 32), fp & 4294967295), if(q < 16, 0, 16)) "
        "& 65535 & ~shiftleft(1L, q % 16) as int))"
    )
    crowded = met.where(F.col("n") > CROWD).select("fp", "node", "key", F.explode(finer).alias("finer"))
    cells = stored(usual.unionByName(crowded), f"{label}-cells")
    x, y = cells.alias("x"), cells.alias("y")
    verified = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.finer") == F.col("y.finer"))
        & (F.col("x.fp") < F.col("y.fp"))
        & (_differing(F.col("x.fp"), F.col("y.fp")) <= MAX_BITS)
        & (F.shiftrightunsigned(F.col("x.key"), 32) == F.expr(_first_shared("x.fp", "y.fp")))
    )
    return x.join(y, verified).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_components(docs: DataFrame, label: str = "simhash") -> DataFrame:
    """doc_id, fp and component_id (least id that isn't null, or null) of every row of ``docs``.

    The nodes are the fingerprints: rows without an id, or that share one, are linked by their texts only."""
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    prints = stored(rows.mapInArrow(_fingerprints, "node long, fp long").withColumnRenamed("node", "doc_id"), f"{label}-prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{label}-distinct")
    labels = least_labels(near_links(distinct.select("fp", F.col("fp").alias("node")), label), label)
    placed = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    placed = stored(placed, f"{label}-placed")
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
