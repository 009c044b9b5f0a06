"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

Each table of the index applies a few pseudo-random rotations (signs and fast Hadamard transforms,
three rounds each) and names, for each rotation, the signed axis the vector is closest to. A vector
is stored under one key in each table and looked up under several: all combinations of the two
closest axes of each rotation (multiprobe).

Vectors that lie close together are not compared pair by pair. Identical vectors are one class
with a count. Every vector belongs to a ball around a centre at most half the threshold's angle
away, so the vectors of a ball are all linked with each other. Keys then yield pairs of balls; a
pair is kept if the angle of its centres and the radii allow a link, and only then the vectors of
the two balls are compared, block by block, which gives counts per vector.

The index is laid out for the vectors at hand: keys hold more rotations where there are more
vectors, fewer where vectors are longer, and there are as many tables as recall asks for at the
threshold; that is measured on random pairs before the index is built (see :func:`layout`).

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and
rows without vec_id, have no links. All finite vectors count, however large or small their
components are: they are scaled by their largest component before their length is taken. Vectors
of different lengths are never linked. vec_id is a key; rows that repeat a vec_id and its vector
count once more each. An empty table gives an empty table. Extra columns, labels among them, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.components import components
from folioforge.llm.util import materialize

THRESHOLD = 0.9
#: Keys for each vector, about: keys get longer until there are so many.
KEYS_PER_VECTOR = 8
AXES = 2
#: Keys of more rotations would be looked up under too many neighbours; they are enough for 4e9 vectors of 64 components.
MOST_ROTATIONS = 5
#: At least so many tables, and more until pairs at the threshold are missed by fewer than MISSED.
TABLES, MISSED = 14, 0.005
#: Random pairs, and tables for each of them, on which the misses of one table are measured.
TRIAL_PAIRS, TRIAL_TABLES = 400, 6
#: Vectors of a ball that are compared at once.
BLOCK = 512
_SAFE = 1e-9
_MIX = np.uint64(0x9E3779B97F4A7C15)


def padded(dims: int) -> int:
    """The power of two to which vectors are filled up with zeros."""
    return 1 << max(1, (dims - 1).bit_length())


def rotations_for(n: int, dims: int) -> int:
    """Rotations in a key: as many as give KEYS_PER_VECTOR keys for each of ``n`` vectors."""
    k = 2
    while (2 * padded(dims)) ** k < KEYS_PER_VECTOR * n and k < MOST_ROTATIONS:
        k += 1
    return k


def random_pairs(n: int, dims: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """``n`` pairs of unit vectors with the given cosine."""
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, n, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * b / np.linalg.norm(b, axis=1)[:, None]


def hits(a: np.ndarray, b: np.ndarray, rotations: int, tables: int) -> np.ndarray:
    """Whether the pair a[i], b[i] meets in each of the tables: one's stored key is among those the other looks up."""
    (own_a, ask_a), (own_b, ask_b) = keys(a, rotations, tables), keys(b, rotations, tables)
    ask_a, ask_b = (x.reshape(len(a), tables, -1) for x in (ask_a, ask_b))
    return (own_a[:, :, None] == ask_b).any(2) | (own_b[:, :, None] == ask_a).any(2)


def layout(n: int, dims: int, threshold: float) -> tuple[int, int]:
    """(rotations in a key, tables) of the index of ``n`` vectors of ``dims`` components."""
    size = padded(dims)
    rotations = rotations_for(n, dims)
    hit = float(hits(*random_pairs(TRIAL_PAIRS, size, threshold), rotations, TRIAL_TABLES).mean())
    hit = min(max(hit, 0.01), 0.99)
    return rotations, max(TABLES, int(np.ceil(np.log(MISSED) / np.log(1 - hit))))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice((-1.0, 1.0), x.shape[1]))
    return x


def keys(unit: np.ndarray, rotations: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(stored, looked up): one key in each table, and AXES ** rotations keys in each table."""
    n, d = unit.shape
    filled = np.zeros((n, padded(d)))
    filled[:, :d] = unit
    own, probes = np.empty((n, tables), np.uint64), []
    for t in range(tables):
        combos = np.full((n, 1), t * 4096 + d, np.uint64)
        for r in range(rotations):
            y = rotate(filled, 1000 * t + r)
            axis = np.argsort(-np.abs(y), axis=1)[:, :AXES]
            code = (2 * axis + (np.take_along_axis(y, axis, 1) < 0)).astype(np.uint64) + np.uint64(1)
            combos = ((combos[:, :, None] * _MIX) ^ (code[:, None, :] * np.uint64(0xD6E8FEB86659FD93))).reshape(n, -1)
            combos ^= combos >> np.uint64(29)
        own[:, t] = combos[:, 0]
        probes.append(combos)
    return own.view(np.int64), np.concatenate(probes, axis=1).view(np.int64)


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]  # neither overflow nor underflow when squared
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the rows that can be linked, in double precision."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))  # NaN is above every number
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(F.coalesce(sound, F.lit(False))).filter(F.exists("v", lambda c: c != 0))


def index(classes: DataFrame, layouts: dict[int, tuple[int, int]]) -> DataFrame:
    """(rep, copies, unit, own, probes) for each class of identical vectors; ``layouts`` by padded length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            out: list = [[None] * len(rows) for _ in range(3)]
            for d in {len(x) for x in rows}:
                at = [i for i, x in enumerate(rows) if len(x) == d]
                unit = _unit([rows[i] for i in at])
                own, probes = keys(unit, *layouts[padded(d)])
                for j, i in enumerate(at):
                    out[0][i], out[1][i], out[2][i] = unit[j].tobytes(), own[j], probes[j]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out[0], pa.binary()), pa.array(out[1], lists), pa.array(out[2], lists)], names=["rep", "copies", "unit", "own", "probes"]
            )

    return classes.select("rep", "copies", "v").mapInArrow(run, "rep bigint, copies bigint, unit binary, own array<bigint>, probes array<bigint>")


def with_cosines(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their cosine, in double precision."""
    u = units.select("rep", "unit")
    rows = pairs.join(u.withColumnsRenamed({"rep": "a", "unit": "ua"}), "a").join(u.withColumnsRenamed({"rep": "b", "unit": "ub"}), "b").select("a", "b", "ua", "ub")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cos = np.full(len(x), -1.0)
            for n in {len(v) for v in x}:
                at = [i for i, (v, w) in enumerate(zip(x, y, strict=True)) if len(v) == len(w) == n]
                u, w = (np.frombuffer(b"".join(z[i] for i in at)).reshape(len(at), -1) for z in (x, y))
                cos[at] = np.einsum("ij,ij->i", u, w)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos, pa.float64())], names=["a", "b", "cosine"])

    return rows.mapInArrow(run, "a bigint, b bigint, cosine double")


def balls(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, ball, angle): each vector's centre, at most half the threshold's angle away; itself if there is no other."""
    half = float(np.cos(np.arccos(threshold) / 2)) + _SAFE
    own = signed.select("rep", F.explode("own").alias("key"))
    rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("rep"))
    firsts = materialize(own.groupBy("key").agg(F.min(rank("rep")).alias("x"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.col("x.rep").alias("b")))
    pairs = materialize(own.join(firsts, "key").select(F.col("rep").alias("a"), "b").filter("a <> b").distinct())
    near = with_cosines(pairs, signed).filter(F.col("cosine") >= half)
    home = near.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("rank"), "b", "cosine")).alias("x"))
    found = signed.select("rep").join(home.select(F.col("a").alias("rep"), "x"), "rep", "left")
    mine = F.col("x").isNotNull() & (F.col("x.rank") < F.xxhash64("rep"))
    return materialize(
        found.select("rep", F.when(mine, F.col("x.b")).otherwise(F.col("rep")).alias("ball"), F.when(mine, F.acos(F.least(F.lit(1.0), "x.cosine"))).otherwise(0.0).alias("angle"))
    )


def cross_links(signed: DataFrame, homes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links between balls: (rep, links) counts per vector, copies included, and linked balls (a, b)."""
    reach = float(np.arccos(threshold)) + 1e-7
    size = materialize(homes.groupBy("ball").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("members")))
    both = signed.select("rep", "own", "probes").join(homes.select("rep", "ball"), "rep")
    stored = both.select("ball", F.explode("own").alias("key")).distinct()
    asked = both.select(F.col("ball").alias("other"), F.explode("probes").alias("key")).distinct()
    pairs = stored.join(asked, "key").filter("ball <> other").select(F.least("ball", "other").alias("a"), F.greatest("ball", "other").alias("b")).distinct()
    pairs = with_cosines(materialize(pairs), signed)
    for side in ("a", "b"):
        pairs = pairs.join(size.select(F.col("ball").alias(side), F.col("radius").alias(f"r{side}"), F.col("members").alias(f"m{side}")), side)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine"))))
    pairs = materialize(pairs.filter(apart <= F.lit(reach) + F.col("ra") + F.col("rb")))

    alone = (F.col("ma") == 1) & (F.col("mb") == 1)  # balls of one vector: their cosine is the answer
    copies = signed.select("rep", "copies")
    close = materialize(pairs.filter(alone & (F.col("cosine") >= threshold)).select("a", "b"))
    single = [close.join(copies.withColumnRenamed("rep", y), y).select("a", "b", F.col(x).alias("rep"), F.col("copies").alias("links")) for x, y in (("a", "b"), ("b", "a"))]

    members = signed.select("rep", "copies", "unit").join(homes.select("rep", "ball"), "rep")
    blocks = lambda m: F.sequence(F.lit(0), ((F.col(m) - 1) / BLOCK).cast("int"))
    grid = pairs.filter(~alone).select("a", "b", "mb", F.explode(blocks("ma")).alias("i")).select("a", "b", "i", F.explode(blocks("mb")).alias("j"))
    # a vector's block follows from its id alone: about BLOCK members share one
    part = lambda n: F.pmod(F.xxhash64("rep"), ((F.col(n) - 1) / BLOCK).cast("bigint") + 1).cast("int")
    placed = materialize(members.join(size.select("ball", "members"), "ball").withColumn("part", part("members")).drop("members"))
    left = grid.join(placed.withColumnsRenamed({"ball": "a", "part": "i"}), ["a", "i"]).withColumn("side", F.lit(0))
    right = grid.join(placed.withColumnsRenamed({"ball": "b", "part": "j"}), ["b", "j"]).withColumn("side", F.lit(1))
    cols = [*_GRID, "side", "rep", "copies", "unit"]
    rows = left.select(*cols).unionByName(right.select(*cols)).repartition(*_GRID).sortWithinPartitions(*_GRID, "side")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple] = []
        for batch in batches:
            at = np.stack([c.to_numpy() for c in batch.columns[:4]], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1, [len(at)]])
            rest, found = list(zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True)), []
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                if (own := tuple(at[low].tolist())) != key:
                    found += _between(key, held, threshold)
                    key, held = own, []
                held += rest[low:high]
            yield _counts(found)
        yield _counts(_between(key, held, threshold))

    dense = rows.mapInArrow(run, "a bigint, b bigint, rep bigint, links bigint")
    counts = materialize(dense.unionByName(single[0]).unionByName(single[1]))
    return counts.groupBy("rep").agg(F.sum("links").alias("links")), counts.select("a", "b").distinct()


_GRID = ("a", "b", "i", "j")


def _between(key: tuple | None, rows: list[tuple], threshold: float) -> list[tuple]:
    """(a, b, rep, links) of the vectors of one block of a ball and one of another: rows of (side, rep, copies, unit)."""
    x, y = ([r for r in rows if r[0] == side] for side in (0, 1))
    if not x or not y:
        return []
    u, w = (np.frombuffer(b"".join(r[3] for r in z)).reshape(len(z), -1) for z in (x, y))
    hit = (u @ w.T) >= threshold
    links = [*(hit @ np.array([r[2] for r in y])), *(np.array([r[2] for r in x]) @ hit)]
    return [(key[0], key[1], r[1], int(n)) for r, n in zip([*x, *y], links, strict=True) if n]


def _counts(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "rep", "links"])


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    rows = usable(vectors, id_col, vec_col)
    classes = materialize(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    power = F.length(F.bin(F.size("v") - 1))  # at most a few dozen of them
    sizes = {1 << r["power"]: r["count"] for r in classes.groupBy(power.alias("power")).count().collect()}
    signed = materialize(index(classes, {d: layout(n, d, threshold) for d, n in sizes.items()}))
    homes = balls(signed, threshold)
    cross, linked = cross_links(signed, homes, threshold)

    weight = signed.select("rep", "copies").join(homes.select("rep", "ball"), "rep")
    inside = materialize(weight.groupBy("ball").agg(F.sum("copies").alias("inside"), F.min("rep").alias("low")))
    joined = components(linked).withColumnRenamed("node", "ball")
    spread = inside.join(joined, "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    lowest = materialize(spread.groupBy("component").agg(F.min("low").alias("component_id")))
    facts = materialize(spread.join(lowest, "component").select("ball", "inside", "component_id"))
    per = materialize(homes.select("rep", "ball").join(facts, "ball").join(cross, "rep", "left").select("rep", (F.col("inside") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))

    out = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    reps = classes.select("v", "rep").join(per, "rep").drop("rep")
    out = out.join(materialize(reps), "v", "left")
    ok = F.col("vec_id").isNotNull()
    component = F.when(ok, F.coalesce("component_id", "vec_id"))
    return out.select(F.col("vec_id").alias(id_col), F.when(ok, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
