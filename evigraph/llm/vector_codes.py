"""Vector code compression: product codes from an exact integer k-means with limb-split matrix products.

Components become integers ``floor(SCALE * x)``. The nearest codebook entry of a part needs the dot products of
whole blocks with all entries. To use BLAS without losing a bit, integers are cut into limbs so short that a sum of
their products stays below 2^53; the float64 products of limbs are exact, are recombined in int64 and give
``|c|^2 - 2 x c``, whose first argmin is the code. Values too large for int64 are recombined in Python integers
instead: slower, as exact.

A round is one pass over the table: a task assigns its rows block by block and keeps one sum and count per
codebook entry, so what it sends is bounded by the codebook, not by its rows. Sums travel as 32-bit limbs in long
columns, Spark adds them up, and the driver divides: it holds the codebook (``ENTRIES`` entries) and nothing of the
table. No row is shuffled; the rows with their errors are only grouped by label at the end, with hot labels salted.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do vectors of another
length than the first kept one (by id, then vector; its length must be a positive multiple of ``PARTS``, shorter ones
are passed over). Rows that repeat an id are coded each and take a place of the first codebook each; null ids come
last. With fewer rows than entries the codebook is smaller. Errors and sums beyond 64 bits are null. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.skew import spread_join
from evigraph.llm.tables import read
from evigraph.session import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK = 8192
LIMB = 32  # bits of the limbs in which sums travel


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text), v array<double> of the vectors that take part, of any length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    label: Column = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    return rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def integers(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * v): int64, or Python integers where a value is too large for it."""
    low = np.floor(v * SCALE)
    if not low.size or np.abs(low).max() < 2**62:
        return low.astype(np.int64)
    # A float beyond 2^52 is an integer; scaled without overflow by exact integers.
    flat = [int(x) * SCALE if abs(x) >= 2.0**52 else int(np.floor(x * SCALE)) for x in v.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(v.shape)


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def limbs(x: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """float64 arrays l with x = sum of l[i] << (bits * i); all but the last in 0 .. 2^bits - 1."""
    out = []
    for _ in range(count - 1):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T of integer matrices, exactly."""
    width, most = x.shape[1], max(largest(x), largest(c), 1)
    bits = (53 - max(width - 1, 0).bit_length() - 1) // 2
    count = -(-(most.bit_length() + 1) // bits)
    kind = np.int64 if 2 * most.bit_length() + width.bit_length() < 62 else object
    left, right = limbs(x, bits, count), limbs(c, bits, count)
    total = np.zeros((len(x), len(c)), kind)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            part = (a @ b.T).astype(np.int64)
            total += (part if kind is np.int64 else part.astype(object)) << (bits * (i + j))
    return total


def squares(x: np.ndarray) -> np.ndarray:
    wide = 2 * largest(x).bit_length() + x.shape[1].bit_length() >= 62
    x = x.astype(object) if wide else x
    return (x * x).sum(axis=1)


def nearest(x: np.ndarray, c: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of each row and the squared distance to it."""
    away = norms[None, :] - 2 * exact_products(x, c)
    code = away.argmin(axis=1) if away.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in away.tolist()], np.int64)
    return code, away[np.arange(len(x)), code] + squares(x)


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of ``width`` components and their integers; a block that holds huge values is cut out of the others."""
    for batch in batches:
        batch = batch.filter(pc.equal(pc.list_value_length(batch.column("v")), width))
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            v = some.column("v").flatten().to_numpy().reshape(-1, width)
            big = np.abs(v).max(axis=1) >= 2.0**17  # leaves squares and products of the rest in int64
            for flag in (big, ~big):
                if flag.any():
                    yield some.filter(pa.array(flag)), integers(v[flag])


Codebook = list[np.ndarray]  # per part: entries x components, int64 or Python integers


def parts_of(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def compact(rows: list[list[int]]) -> np.ndarray:
    big = max((abs(v) for r in rows for v in r), default=0) >= 2**62
    return np.array(rows, object if big else np.int64)


def first_codebook(kept: DataFrame) -> tuple[int, Codebook]:
    """Length of the vectors that take part, and the parts of those with the smallest ids."""
    order = [F.asc_nulls_last("vec_id"), F.asc("v")]
    length = kept.filter((F.size("v") > 0) & (F.size("v") % PARTS == 0)).orderBy(*order).limit(1).select(F.size("v")).collect()
    if not length:
        return 0, []
    width = length[0][0]
    rows = kept.filter(F.size("v") == width).orderBy(*order).limit(ENTRIES).select("v").collect()
    x = integers(np.array([r["v"] for r in rows], np.float64))
    return width, [np.ascontiguousarray(p) for p in parts_of(x)]


def next_codebook(kept: DataFrame, width: int, codebook: Codebook) -> Codebook:
    """One round: every part is assigned, entries become the floored means of their parts."""
    shared = kept.sparkSession.sparkContext.broadcast(codebook)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        norms = [squares(c) for c in book]
        counts = [np.zeros(len(c), np.int64) for c in book]
        sums = [np.zeros(c.shape, object) for c in book]
        for _, x in blocks(batches, width):
            for p, part in enumerate(parts_of(x)):
                code, _ = nearest(part, book[p], norms[p])
                order = np.argsort(code, kind="stable")
                some, at = np.unique(code[order], return_index=True)
                counts[p] += np.bincount(code, minlength=len(book[p]))
                part = part.astype(object) if largest(part) >= 2**48 else part
                sums[p][some] += np.add.reduceat(part[order], at, axis=0).astype(object)
        for p, total in enumerate(sums):
            rows = []
            for e in np.flatnonzero(counts[p]).tolist():
                rows.append((p, e, -1, 0, int(counts[p][e])))
                for k, value in enumerate(total[e].tolist()):
                    limb = 0
                    while True:
                        last = -(1 << LIMB) <= value < 1 << LIMB
                        rows.append((p, e, k, limb, value if last else value & ((1 << LIMB) - 1)))
                        if last:
                            break
                        value, limb = value >> LIMB, limb + 1
            columns = [pa.array(c, pa.int64() if i == 4 else pa.int32()) for i, c in enumerate(zip(*rows, strict=True))]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "limb", "value"])

    sent = kept.select("v").mapInArrow(assign, "part int, entry int, place int, limb int, value long")
    added = sent.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    book = [[[int(v) for v in row] for row in c.tolist()] for c in codebook]
    counts: dict[tuple[int, int], int] = {}
    sums: dict[tuple[int, int], list[int]] = {}
    for r in added.collect():  # bounded by the codebook: entries x components
        if r["place"] < 0:
            counts[r["part"], r["entry"]] = r["value"]
        else:
            sums.setdefault((r["part"], r["entry"]), [0] * (width // PARTS))[r["place"]] += r["value"] << (LIMB * r["limb"])
    for (p, e), n in counts.items():
        book[p][e] = [s // n for s in sums[p, e]]
    shared.destroy()
    return [compact(c) for c in book]


def codebooks_digest(codebook: Codebook) -> str:
    return hashlib.sha256(",".join(str(int(v)) for c in codebook for row in c.tolist() for v in row).encode()).hexdigest()


def fit_codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[int, Codebook]:
    """Length of the vectors and the codebook of each part; (0, []) if no vector takes part."""
    kept = usable(vectors)
    width, codebook = first_codebook(kept)
    for _ in range(rounds if width else 0):
        codebook = next_codebook(kept, width, codebook)
    return width, codebook


def encode(vectors: DataFrame, width: int, codebook: Codebook) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of every vector that takes part."""
    shared = vectors.sparkSession.sparkContext.broadcast((width, codebook))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, book = shared.value
        norms = [squares(c) for c in book]
        for rows, x in blocks(batches, width) if width else ():
            found = [nearest(part, book[p], norms[p]) for p, part in enumerate(parts_of(x))]
            code = np.stack([c for c, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            error = sum(e.astype(object) if e.dtype == object else e for _, e in found).tolist()
            kept = [e if e < 2**63 else None for e in error]
            codes = [code[i : i + 2 * PARTS] for i in range(0, len(code), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array(codes, pa.string()), pa.array(kept, pa.int64())], ["vec_id", "label", "code", "error"])

    return usable(vectors).mapInArrow(run, "vec_id long, label string, code string, error long")


def decode(codes: DataFrame, codebook: Codebook) -> DataFrame:
    """vec_id and the approximate vector v array<double> of every row of ``codes`` (vec_id, code)."""
    shared = codes.sparkSession.sparkContext.broadcast(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = [c.astype(np.float64) / SCALE for c in shared.value]
        for batch in batches:
            picks = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(-1, PARTS)
            v = np.concatenate([c[picks[:, p]] for p, c in enumerate(book)], axis=1) if len(picks) else np.zeros((0, 1))
            starts = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(starts, v.ravel())], ["vec_id", "v"])

    return codes.filter("code IS NOT NULL").select("vec_id", "code").mapInArrow(run, "vec_id long, v array<double>")


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    width, codebook = fit_codebooks(vectors)
    coded = cut_lineage(encode(vectors, width, codebook).withColumn("key", F.concat(F.lit("="), "label")).fillna("", ["key"]).drop("label"))
    exact = F.sum(F.col("error").cast("decimal(20,0)"))
    totals = coded.groupBy("key").agg(F.when(F.count("*") == F.count("error"), exact).cast("decimal(38,0)").alias("total"))
    with_total = spread_join(coded, totals, ["key"], how="left")
    return with_total.select("vec_id", "code", "error", F.expr("try_cast(total AS bigint)").alias("label_error"), F.lit(codebooks_digest(codebook)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read(spark, sf_dir, "embeddings"))


def check_sql() -> str:
    """The rounds unrolled: integers, distances by part, means by floor division."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(
            f"""d{i} AS MATERIALIZED (SELECT u, p, entry, sum((x - y) * (x - y)) AS d FROM xs JOIN c{i} USING (p, k) GROUP BY ALL),
            a{i} AS MATERIALIZED (SELECT u, p, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM d{i} GROUP BY ALL)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""m{i} AS (SELECT p, k, entry, sum(x)::BIGINT AS s, count(*) AS n FROM xs JOIN a{i} USING (u, p) GROUP BY ALL),
                c{i + 1} AS MATERIALIZED (SELECT p, k, entry, coalesce(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END, y) AS y FROM c{i} LEFT JOIN m{i} USING (p, k, entry))"""
            )
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS u, vec_id, label, embedding FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    comp AS (SELECT u, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {PARTS} AS w FROM kept),
    xs AS MATERIALIZED (SELECT u, CAST(i // w AS INTEGER) AS p, CAST(i % w AS INTEGER) AS k, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM comp),
    c0 AS MATERIALIZED (SELECT p, k, u AS entry, x AS y FROM xs WHERE u < {ENTRIES}),
    {", ".join(steps)},
    e AS (SELECT u, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY u),
    h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, entry, k)) AS codebooks_sha256 FROM c{ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN e USING (u), h"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
CHECKS = {"op13_vector_codes": check_sql()}
