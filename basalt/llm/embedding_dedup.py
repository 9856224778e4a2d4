"""Embedding near-dedup by PCA-ordered tiled comparison.

1. Equal vectors of a label collapse into one row with a count; copies are never paired.
2. Unit vectors are rotated so that leading dimensions hold most of their variance. The rotation comes from a bounded sample
   (PCA_SAMPLE vectors expected); being orthogonal it changes no cosine, only how early a comparison can stop.
3. Vectors are range-partitioned by label and leading coordinates and cut into tiles, neighbouring tiles into bands. Bands, and tiles of
   theirs, are compared only if their leading coordinates come within sqrt(2 - 2 * threshold), the largest distance that a link allows.
4. A tile pair accumulates products over leading dimensions first; what the remaining dimensions can add is bounded by the
   product of suffix norms, and pairs whose bound stays below the threshold stop. Pairs within 2e-9 of the threshold are decided on
   the vectors as given, so that the rotation's rounding decides nothing. Vectors are first scaled by powers of two, so that
   tiny and huge components count.
5. A tile pair returns one row per linked vector: how many vectors it links to, and the smallest vector of its component
   there. Counts are summed and components joined in a distributed way.

Defined cases: null labels, null or empty or zero vectors, and null or non-finite components link with nothing; vectors of
different sizes do not link; repeated rows are vectors of their own that link with each other; null ids act as the largest
id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import NO_ID, cut, real_id
from basalt.llm.components import components, smallest_reachable

THRESHOLD, TILE, PCA_SAMPLE = 0.98, 512, 4096
#: Vector sizes that get a rotation, leading coordinates that bound a tile, and tiles of a band.
SIZES, BOX, BAND = 16, 8, 8
#: Leading dimensions after which pairs are dropped by their bound.
STOPS = (8, 16, 32)
_SLACK = 1e-9


def rotation_of(sample: np.ndarray) -> np.ndarray:
    """Eigenvectors of the second-moment matrix of unit vectors, by falling eigenvalue."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, ::-1]


def linked(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows with cosine >= threshold; of a tile with itself only i < j."""
    d = a.shape[1]
    done, rows, columns, partial = 0, None, None, np.zeros((len(a), len(b)))
    for stop in [*[s for s in STOPS if s < d], d]:
        if rows is None:
            partial = partial + a[:, done:stop] @ b[:, done:stop].T
        else:
            partial = partial + np.einsum("ij,ij->i", a[rows, done:stop], b[columns, done:stop])
        done = stop
        rest_a, rest_b = (np.sqrt(np.maximum(np.einsum("ij,ij->i", x[:, stop:], x[:, stop:]), 0)) for x in (a, b))
        if stop == d:
            rest_a, rest_b, limit = np.zeros(len(a)), np.zeros(len(b)), threshold
        else:
            limit = threshold - _SLACK
        if rows is None:
            alive = partial + np.outer(rest_a, rest_b) >= limit
            if same:
                alive = np.triu(alive, 1)
            many = np.count_nonzero(alive)
            if many * 8 < alive.size or stop == d:
                rows, columns = np.nonzero(alive)
                partial = partial[rows, columns]
        else:
            alive = partial + rest_a[rows] * rest_b[columns] >= limit
            rows, columns, partial = rows[alive], columns[alive], partial[alive]
        if rows is not None and not len(rows):
            break
    return rows, columns


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: cosines stay as they are, products neither vanish nor overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cosine_links(a: np.ndarray, b: np.ndarray, turn: np.ndarray | None, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """linked() for vectors as given; pairs so close to the threshold that the rotation may decide are judged on the vectors as given."""
    ua, ub = (unit(x) if turn is None else unit(x) @ turn for x in (a, b))
    i, j = linked(ua, ub, threshold - _SLACK, same)
    near = np.abs(np.einsum("ij,ij->i", ua[i], ub[j]) - threshold) <= 2 * _SLACK
    keep = np.ones(len(i), dtype=bool)
    x, y = a[i[near]], b[j[near]]
    keep[near] = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) >= threshold
    return i[keep], j[keep]


def rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """PCA of a bounded sample for the SIZES commonest vector sizes; other sizes are compared in the order of their own dimensions."""
    sizes = {r["size"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(SIZES).collect()}
    total = sum(sizes.values())
    share = int(min(1.0, PCA_SAMPLE / max(1, total)) * (1 << 30))
    sample = classes.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).select("embedding").limit(4 * PCA_SAMPLE)
    by_size: dict[int, list] = {}
    for r in sample.toLocalIterator():
        if len(r[0]) in sizes:
            by_size.setdefault(len(r[0]), []).append(r[0])
    return {d: rotation_of(unit(scaled(np.array(rows, dtype=np.float64)))) for d, rows in by_size.items()}


def tiles(classes: DataFrame, tile: int, turns: dict[int, np.ndarray], reach: float) -> DataFrame:
    """(label, vec_id, copies, embedding) -> tiles (label, size, band, tile, lo, hi, ids, copies, vectors).

    Vectors are ordered by cell (of width `reach`) of their leading coordinate and, in a cell, by the next one. lo and hi bound a
    tile's leading coordinates; neighbouring tiles of a label make a band.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    def leading(x: np.ndarray) -> np.ndarray:
        got = unit(x) @ turns[x.shape[1]][:, :BOX] if x.shape[1] in turns else unit(x)[:, :BOX]
        return np.hstack([got, np.zeros((len(x), BOX - got.shape[1]))])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [scaled(np.asarray(v, dtype=np.float64)[None]) for v in batch.column(3).to_pylist()]
            lead = np.array([leading(v)[0, :2] for v in vectors]).reshape(-1, 2)
            columns = [pa.array([v.shape[1] for v in vectors], pa.int32()), pa.array(np.floor(lead[:, 0] / reach).astype(np.int32)), pa.array(lead[:, 1]), pa.array([v.tobytes() for v in vectors], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["label", "vec_id", "copies", "size", "cell", "next", "vector"])

    kind = classes.schema["label"].dataType.simpleString()
    turned = cut(classes.select("label", "vec_id", "copies", "embedding").mapInArrow(turn, f"label {kind}, vec_id long, copies long, size int, cell int, next double, vector binary"), "turned")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by label, size, cell and next coordinate."""
        number, last, in_band, band = TaskContext.get().partitionId() << 33, None, 0, 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number, last, in_band, band
            (label, size), number, in_band = rows[0][0], number + 1, in_band + 1
            if (label, size) != last or in_band >= BAND:
                last, in_band, band = (label, size), 0, number
            box = leading(np.frombuffer(b"".join(r[3] for r in rows), np.float64).reshape(-1, size))
            columns = [
                pa.array([label], batch.schema.field(0).type), pa.array([size], pa.int32()), pa.array([band]), pa.array([number]), pa.array([box.min(axis=0).tolist()]),
                pa.array([box.max(axis=0).tolist()]), *[pa.array([np.array([r[i] for r in rows], np.int64).tobytes()], pa.binary()) for i in (1, 2)], pa.array([b"".join(r[3] for r in rows)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["label", "size", "band", "tile", "lo", "hi", "ids", "copies", "vectors"])

        held: list[tuple] = []
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for row in zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(6).to_pylist(), strict=True):
                if held and (len(held) >= tile or held[0][0] != row[0]):
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    order = ["label", "size", "cell", "next"]
    spread = turned.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(spread.mapInArrow(gather, f"label {kind}, size int, band long, tile long, lo array<double>, hi array<double>, ids binary, copies binary, vectors binary"), "tiles")


def band_pairs(made: DataFrame, reach: float) -> DataFrame:
    """(a, b): bands, a <= b, whose boxes come within reach; met through the cells of the leading coordinate that they cover."""
    corner = lambda f, side: F.array(*[f(F.col(side)[i]) for i in range(BOX)]).alias(side)
    bands = made.groupBy("label", "size", "band").agg(corner(F.min, "lo"), corner(F.max, "hi"))
    cell = lambda side: F.floor(F.col(side)[0] / reach)
    a = bands.select("label", "size", F.col("band").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    b = bands.select("label", "size", F.col("band").alias("b"), "lo", "hi", F.explode(F.sequence(cell("lo") - 1, cell("hi") + 1)).alias("cell"))
    gap = [F.greatest(F.col("lo")[i] - F.col("hi_a")[i], F.col("lo_a")[i] - F.col("hi")[i], F.lit(0.0)) for i in range(BOX)]
    close = sum((g * g for g in gap[1:]), gap[0] * gap[0]) <= reach * reach
    return cut(a.join(b, ["label", "size", "cell"]).where((F.col("a") <= F.col("b")) & close).select("a", "b").distinct(), "pairs")


def tile_links(made: DataFrame, threshold: float, turns: dict[int, np.ndarray], reach: float) -> DataFrame:
    """Tiles -> (vec_id, links, root), a row for each vector with links in a tile pair.

    A pair of bands is one unit of work: a tile travels once for each band that its own meets, not for each tile.
    """
    import pyarrow as pa

    side = lambda band, k: F.struct(F.col(band).alias("band"), F.lit(k).alias("side"))
    both = F.when(F.col("a") == F.col("b"), F.array(side("a", 0))).otherwise(F.array(side("a", 0), side("b", 1)))
    wanted = cut(band_pairs(made, reach).select("a", "b", F.explode(both).alias("x")).select("a", "b", "x.band", "x.side"), "units")
    rows = wanted.join(made.select("band", "tile", "size", "lo", "hi", "ids", "copies", "vectors"), "band").select("a", "b", "side", "tile", "size", "lo", "hi", "ids", "copies", "vectors")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(x: tuple, y: tuple, same: bool) -> pa.RecordBatch | None:
            gap = np.maximum(0, np.maximum(x[0] - y[1], y[0] - x[1]))
            if gap @ gap > reach * reach:
                return None
            (ids_a, copies_a, va), (ids_b, copies_b, vb) = x[2:], y[2:]
            i, j = cosine_links(va, vb, turns.get(va.shape[1]), threshold, same)
            if not len(i):
                return None
            ids, n = (ids_a, np.zeros(len(ids_a), np.int64)) if same else (np.concatenate([ids_a, ids_b]), np.zeros(len(ids_a) + len(ids_b), np.int64))
            at = j if same else j + len(ids_a)
            np.add.at(n, i, copies_b[j])
            np.add.at(n, at, copies_a[i])
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            root = ids[order][smallest_reachable(len(ids), place[i], place[at])][place]
            some = n > 0
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(root[some])], names=["vec_id", "links", "root"])

        last, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, side, _, size, lo, hi, ids, copies, vectors = (batch.column(c)[k].as_py() for c in range(10))
                if (a, b) != last:
                    last, held = (a, b), []
                now = (np.array(lo), np.array(hi), np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, size))
                found = [links(x, now, False) for x in held] if side or a == b else []
                if a == b:
                    found.append(links(now, now, True))
                if not side:
                    held.append(now)
                yield from (f for f in found if f is not None)

    # a unit is heavy: units are dealt out evenly, a band's own tiles first
    return rows.repartition("a", "b").sortWithinPartitions("a", "b", "side", "tile").mapInArrow(compare, "vec_id long, links long, root long")


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE
) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per vector."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(
        F.coalesce(vectors[id_col].cast("long"), F.lit(NO_ID)).alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("embedding")
    )
    fits = F.col("label").isNotNull() & F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0)
    keys = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")]
    valid = rows.where(fits).select("id", "label", "embedding", *keys)
    classes = cut(
        valid.groupBy("label", "k1", "k2").agg(F.min("id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "classes"
    )
    turns, reach = rotations(classes), float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    found = cut(tile_links(tiles(classes, tile, turns, reach), threshold, turns, reach), "links")
    grouped = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    known = classes.select("label", "k1", "k2", "vec_id", "copies").join(counts, "vec_id", "left").join(grouped.withColumnRenamed("vertex", "vec_id"), "vec_id", "left")
    known = cut(known.select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component")), "known")
    mine = rows.select("id", F.when(fits, F.col("label")).alias("label"), *[F.when(fits, k).alias(n) for n, k in (("k1", F.xxhash64("embedding")), ("k2", F.xxhash64(F.lit(1), "embedding")))])
    return mine.join(known, ["label", "k1", "k2"], "left").select(
        real_id().alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.coalesce("component", "id") != NO_ID, F.coalesce("component", "id")).alias("component_id"), (F.coalesce("component", "id") == F.col("id")).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
least AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.u = e.vec_id LEFT JOIN counts c ON c.u = e.vec_id
"""
