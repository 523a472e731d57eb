"""Embedding near-duplicates by E8 lattice hashing.

Random rotations (seeded orthonormal matrices) are cut into projections to eight dimensions, one
for each table. One rotation gives vectors of 64 dimensions and more enough tables; narrower ones
get as many rotations as make ``TABLES`` tables. A table decodes a vector's projection, divided by ``scale``, to its nearest E8
lattice point. A vector is stored in its own cell of every table and asks, in every table, its
own cell and those of the ``probes`` neighbouring lattice points nearest to its projection. The
tables of a rotation split it, so a pair that is far apart in one is nearer in the others: with
``scale`` 0.18 and 5 probes a pair at cosine 0.9 is found in some table almost surely, at every
width (see the recall test). Pairs that meet are verified by cosine in double precision.

Equal vectors are one class first and count with their number of rows. A cell is compared in
tiles: its vectors are dealt into chunks of about ``CHUNK`` and a task compares two chunks, so
no cell, however full, reaches one task, and no pair is written out. A link that meets in
several cells or tables is counted in the first only: the two vectors' cells and probes tell a
task whether an earlier table or cell has the pair. Tiles give per vector its number of links, and
spanning links of the tile's own components, from which components are joined.

Not usable (linked with nothing, their own component): null or zero vectors and those with null
or non-finite components. Vectors of different lengths never link. Rows that repeat an id are
separate vectors under that id. Null ids: linked like others but never name a component.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpulse.llm.common import materialize
from netpulse.llm.graph import components
from netpulse.llm.textops import U64, mix

THRESHOLD = 0.9
SCALE, PROBES = 0.18, 5
TABLES = 8  # at least
CHUNK = 1024  # vectors of a cell in one tile side
SEED = 8


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point: D8 (integers of even sum) or D8 moved by one half, whichever is nearer."""

    def d8(y: np.ndarray) -> np.ndarray:
        f = np.rint(y)
        odd = np.flatnonzero(f.sum(1) % 2)
        e = y[odd] - f[odd]
        worst = np.abs(e).argmax(1)
        f[odd, worst] += np.where(e[np.arange(len(odd)), worst] >= 0, 1, -1)
        return f

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def neighbours() -> np.ndarray:
    """The 240 lattice points nearest to the origin."""
    points = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            p = np.zeros(8)
            p[i], p[j] = a, b
            points.append(p)
    points += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(points)


def cell_key(points: np.ndarray, table: int) -> np.ndarray:
    """64 bits that name lattice points of a table."""
    key = np.full(points.shape[:-1], table + 1, U64)
    for i in range(8):
        key = mix(key ^ np.rint(points[..., i] * 2).astype(np.int64).view(U64), i)
    return key


class Lattice:
    """Cells of unit vectors of one dimension: (n, tables, 1 + probes) keys, the own cell first."""

    def __init__(self, dim: int, scale: float, probes: int) -> None:
        width = -(-dim // 8) * 8
        rotations = -(-TABLES * 8 // width)
        rng = np.random.default_rng(SEED + dim)
        self.rotation = np.concatenate([np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dim] for _ in range(rotations)])
        self.tables, self.probes = rotations * width // 8, probes
        self.scale = scale * np.sqrt(64.0 / width)  # projections shrink with a rotation's number of tables
        self.around = neighbours()

    def cells(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros((len(unit), self.tables, 1 + self.probes), U64)
        for t in range(self.tables):
            x = unit @ self.rotation[8 * t : 8 * t + 8].T / self.scale
            own = decode(x)
            out[:, t, 0] = cell_key(own, t)
            if self.probes:
                # squared distance to own + v, up to what is the same for all v
                far = 2.0 - 2.0 * (x - own) @ self.around.T
                far[:, 112:] += (self.around[112:] ** 2).sum(1) - 2.0
                near = np.argpartition(far, self.probes - 1, axis=1)[:, : self.probes]
                out[:, t, 1:] = cell_key(own[:, None, :] + self.around[near], t)
        return out


def _vectors(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    raw = flat.reshape(n, -1)
    norm = np.sqrt((raw * raw).sum(1))
    return raw / norm[:, None], norm


def _tables(dim: int, scale: float, probes: int):
    """(cell, own, cls): a class in every cell that it is stored in or asks."""

    def run(batches):
        lattice = Lattice(dim, scale, probes)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                unit, _ = _vectors(part.column("embedding"), part.num_rows)
                cells = lattice.cells(unit).reshape(len(unit), -1)
                own = np.tile(np.arange(1 + probes) == 0, lattice.tables)
                take = pa.array(np.repeat(np.arange(len(unit)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.ravel().view(np.int64)), pa.array(np.tile(own, len(unit))), part.column("cls").take(take)],
                    ["cell", "own", "cls"])

    return run


def local_components(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row index it is connected with."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _tiles(dim: int, scale: float, probes: int, threshold: float):
    """Per tile: (a, b, links) with a's links counted here, and b the class it is connected with."""

    def tile(lattice: Lattice, cell: int, left: list, right: list):
        """Both sides are (cls, weight, own, vectors); within one chunk they are the same."""
        same = left is right
        (ca, wa, oa, ua), (cb, wb, ob, ub) = left, right
        linked = ua @ ub.T >= threshold
        linked &= oa[:, None] | ob[None, :]  # one of the two is stored here
        if same:
            linked &= np.arange(len(ca))[:, None] < np.arange(len(ca))[None, :]
        i, j = np.nonzero(linked)
        if not len(i):
            return
        rows_i, back_i = np.unique(i, return_inverse=True)
        rows_j, back_j = np.unique(j, return_inverse=True)
        # is this the first place where the pair meets? tables in order, within one the smaller cell
        ka, kb = lattice.cells(ua[rows_i]), lattice.cells(ub[rows_j])
        here = U64(cell & 0xFFFFFFFFFFFFFFFF)
        first = np.zeros(len(i), U64)
        todo = np.arange(len(i))
        for t in range(lattice.tables):
            a, b = ka[back_i[todo], t], kb[back_j[todo], t]
            best = np.full(len(todo), 0xFFFFFFFFFFFFFFFF, U64)
            met = np.zeros(len(todo), bool)
            for k in range(1 + probes):
                for hit, key in ((a[:, k] == b[:, 0], a[:, k]), (b[:, k] == a[:, 0], b[:, k])):
                    best = np.where(hit & (key < best), key, best)
                    met |= hit
            first[todo[met]] = best[met]
            todo = todo[~met]
            if not len(todo):
                break
        mine = first == here
        i, j = i[mine], j[mine]
        if not len(i):
            return
        if same:
            n = len(ca)
            m = np.zeros((n, n), bool)
            m[i, j] = m[j, i] = True
            links = np.bincount(i, wb[j], n) + np.bincount(j, wa[i], n)
            root = local_components(m)
            at = np.flatnonzero(links > 0)
            yield ca[at], ca[root[at]], links[at]
        else:
            la, lb = np.bincount(i, wb[j], len(ca)), np.bincount(j, wa[i], len(cb))
            m = np.zeros((len(ca) + len(cb),) * 2, bool)
            m[i, len(ca) + j] = m[len(ca) + j, i] = True
            root = local_components(m)
            cls, links = np.concatenate([ca, cb]), np.concatenate([la, lb])
            at = np.flatnonzero(links > 0)
            yield cls[at], cls[root[at]], links[at]

    def run(batches):
        lattice = Lattice(dim, scale, probes)

        def done(group, key):
            cell, i, j = key
            sides = []
            for chunk in dict.fromkeys((i, j)):
                parts = [g for g in group if len(g[0])]
                cls, weight, own, vec, ch = (np.concatenate([p[k] for p in parts]) for k in range(5))
                at = ch == chunk
                sides.append((cls[at], weight[at], own[at], vec[at]))
            left, right = sides[0], sides[-1]
            if len(left[0]) and len(right[0]):
                for a, b, n in tile(lattice, cell, left, right):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int64))], ["a", "b", "links"])

        held, held_key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, _ = _vectors(batch.column("embedding"), batch.num_rows)
            cell, i, j = (batch.column(c).to_numpy() for c in ("cell", "i", "j"))
            cols = [batch.column("cls").to_numpy(), batch.column("weight").to_numpy(),
                    batch.column("own").to_numpy(zero_copy_only=False), unit, batch.column("chunk").to_numpy()]
            new = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            for a, b in zip(new, np.append(new[1:], len(cell))):
                key = (int(cell[a]), int(i[a]), int(j[a]))
                if key != held_key:
                    if held:
                        yield from done(held, held_key)
                    held, held_key = [], key
                held.append([c[a:b] for c in cols])
        if held:
            yield from done(held, held_key)

    return run


def _links(classes: DataFrame, dim: int, scale: float, probes: int, threshold: float) -> DataFrame:
    """Per tile of the vectors of one length: (a, b, links)."""
    placed = materialize(classes.mapInArrow(_tables(dim, scale, probes), "cell long, own boolean, cls long"))
    full = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).where("n > 1 and any")
    full = full.select("cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = placed.join(full, "cell").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    # chunk c takes part in the tiles (c, c..) and (..c, c)
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(
        F.least(x, F.col("chunk")).alias("i"), F.greatest(x, F.col("chunk")).alias("j")))
    rows = dealt.select("cell", "own", "cls", "chunk", F.inline(tiles)).join(classes, "cls")
    rows = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return rows.mapInArrow(_tiles(dim, scale, probes, threshold), "a long, b long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    scale: float = SCALE, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    vec = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":  # floats travel as they are
        vec = vec.cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite
                        & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("cls", F.when(usable, F.xxhash64("embedding")))
    classes = materialize(rows.where("cls is not null").groupBy("cls").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding")))
    found = None
    for dim in sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect()):  # the few lengths in use
        part = _links(classes.where(F.size("embedding") == dim).select("cls", "weight", "embedding"), dim, scale, probes, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = classes.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(0).cast("long").alias("links"))
    found = materialize(found)
    labels = components(found.select("a", "b")).withColumnRenamed("node", "cls")
    counted = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    known = classes.select("cls", "weight", "least").join(counted, "cls", "left").join(labels, "cls", "left").select(
        "cls", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("comp"))
    lowest = known.groupBy("comp").agg(F.min("least").alias("lowest"))
    known = known.join(lowest, "comp").select("cls", (F.col("weight") - 1 + F.col("links")).alias("n_links"), "lowest")
    out = rows.select("vec_id", "cls").join(known, "cls", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("cls").isNotNull(), F.col("lowest")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
