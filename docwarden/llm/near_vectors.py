"""Vectors of one label that are nearly parallel, by Euclidean p-stable hashing, and their groups.

1. Equal vectors of one label form a class; everything below is about classes.
2. Every vector is scaled to length one and rounded to whole numbers, so that projections are exact and equal on every
   machine.  A table's bucket is the floor of ``m`` Gaussian projections, shifted at random, over the width of a cell.
   From the number of classes follow ``m`` (unrelated vectors share a bucket with a few others) and the number of
   tables (a pair at exactly the least cosine is missed by all of them with a chance of at most :data:`MISSED`).
3. Dense groups first: crowded buckets of a few finer tables propose centres.  Vectors within half the greatest angle
   of a centre form its core.  Any two of a core are linked, by the triangle inequality of angles, so a core's
   links are counted and never listed.
4. The members of a bucket that are not of one core are compared by the bits of further projections' signs
   (a linked pair is lost with a chance below 1e-6), and the pairs that pass by their exact cosine.
   Buckets of more than :data:`BLOCK` members are cut into blocks, which meet block by block.
5. Links and cores make components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .stored import Stored, release
from .text_bytes import U64, mix64, worker_cache
from .vector_rows import few_rows, lengths, vectors

COSINE = 0.93
MISSED = 1e-3
#: Width of a cell for vectors of length one; members of a bucket that are wanted of unrelated vectors.
WIDTH, FILL = 2.5, 64
#: Tables handled at once, so that the rows in flight are a bounded multiple of the input.
TABLES = 16
#: Tables and further projections by which dense groups are found, and the members that make their buckets crowded.
CORE_TABLES, CORE_FINER, CROWDED = 8, 10, 16
#: A bucket with more members is cut into blocks of about so many.
BLOCK = 2048
#: Sign bits of a pair that may differ: 5.6 standard deviations over the mean at the least cosine.
SIGNS, SIGMAS = 128, 5.6
UNIT, STEP = 1 << 20, 1 << 10
ADDED = ["n_links", "component_id", "kept"]


def same_cell(distance: float, width: float = WIDTH) -> float:
    """The chance that two points at ``distance`` share the cell of one projection."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def shape(classes: int, cosine: float = COSINE) -> tuple[int, int]:
    """Projections of a table and number of tables for so many classes of one label."""
    near, far = same_cell(math.sqrt(2 - 2 * cosine)), same_cell(math.sqrt(2))
    m = max(4, math.ceil(math.log(max(classes, 1) / FILL) / -math.log(far)))
    return m, math.ceil(math.log(MISSED) / math.log1p(-(near**m)))


def _projections(dim: int, tables: int, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    def make():
        r = np.random.Generator(np.random.PCG64([seed, dim, m]))
        # One draw per table, so that the first tables are the same however many there are.
        drawn = [(r.standard_normal((dim, m)), r.random(m)) for _ in range(tables)]
        lines = np.concatenate([np.rint(d * STEP) for d, _ in drawn], axis=1)
        return lines, np.floor(np.concatenate([s for _, s in drawn]) * WIDTH * UNIT * STEP)

    return worker_cache(("near_vectors", dim, tables, m, seed), make)


def _whole_directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.rint(x / np.sqrt((x * x).sum(axis=1, keepdims=True)) * UNIT)


def bucket_names(x: np.ndarray, group: np.ndarray, first: int, last: int, m: int, seed: int) -> np.ndarray:
    """Names of the buckets of tables ``first`` to ``last`` (a column each)."""
    lines, shift = _projections(x.shape[1], last, m, seed)
    cut = slice(first * m, last * m)
    # All numbers are whole and below 2**53, so sums are exact in any order.
    cell = np.floor((_whole_directions(x) @ lines[:, cut] + shift[cut]) / float(WIDTH * UNIT * STEP)).astype(np.int64).view(U64)
    cell = cell.reshape(len(x), last - first, m)
    with np.errstate(over="ignore"):
        name = mix64(group[:, None] + np.arange(first, last).astype(U64)[None] * U64(0x9E3779B97F4A7C15) + U64(seed))
        for i in range(m):
            name = mix64(name * U64(0xA24BAED4963EE407) + cell[:, :, i])
    return name.view(np.int64)


def sign_bits(x: np.ndarray, seed: int) -> np.ndarray:
    lines, _ = _projections(x.shape[1], 1, SIGNS, seed + 1)
    return np.packbits(_whole_directions(x) @ lines > 0, axis=1, bitorder="little").view(np.int64)


def sign_limit(cosine: float) -> int:
    p = math.acos(cosine) / math.pi
    return math.ceil(SIGNS * p + SIGMAS * math.sqrt(SIGNS * p * (1 - p)))


def cosines(a: np.ndarray, b: np.ndarray, near: float) -> np.ndarray:
    """Cosines of rows in double precision; those within 1e-9 of ``near`` from exactly rounded sums."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    out = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    for i in np.flatnonzero(np.abs(out - near) < 1e-9).tolist():
        u, v = a[i].tolist(), b[i].tolist()
        out[i] = math.sumprod(u, v) / math.sqrt(math.sumprod(u, u) * math.sumprod(v, v))
    return out


def _classes(rows: DataFrame) -> DataFrame:
    """Add ``cls``, a digest of label and vector, and ``dim``; null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            column, label = batch.column("v"), batch.column("label").to_pylist()
            size = lengths(column)
            cls = [None] * batch.num_rows
            for dim in np.unique(size[size > 0]).tolist():
                row, x = vectors(column, dim)
                x = x + 0.0  # -0.0 counts as 0.0
                for i, v, zero in zip(row.tolist(), x, ~x.any(axis=1)):
                    if label[i] is not None and not zero:
                        named = label[i].encode() + b"\0" + v.tobytes()
                        cls[i] = hashlib.blake2b(named, digest_size=16).digest()
            new = [pa.array(cls, pa.binary()), pa.array(size.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "cls", "dim"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cls", T.BinaryType()), T.StructField("dim", T.IntegerType())]))


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = lengths(batch.column("v"))
    for dim in np.unique(size).tolist():
        yield vectors(batch.column("v"), dim)


def _longs(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64)


def _buckets(classes: DataFrame, first: int, last: int, m: int, seed: int, signs: bool) -> DataFrame:
    """A row ``key, id, core`` (and sign bits) per class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 2048):
            ids, core = _longs(batch.column("id")), _longs(batch.column("core"))
            group = _longs(batch.column("grp")).view(U64)
            for row, x in _by_dimension(batch):
                names = bucket_names(x, group[row], first, last, m, seed)
                out = [names.ravel(), np.repeat(ids[row], last - first), np.repeat(core[row], last - first)]
                if signs:
                    out += [np.repeat(s, last - first) for s in sign_bits(x, seed).T]
                yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=["key", "id", "core", "s0", "s1"][: len(out)])

    return classes.select("id", "grp", "core", "v").mapInArrow(run, "key long, id long, core long" + ", s0 long, s1 long" * signs)


def _pair_cosines(pairs: DataFrame, vector_type: T.DataType, near: float) -> DataFrame:
    """``a, b, cosine`` for rows ``a, b, va, vb`` whose vectors have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            size = lengths(batch.column("va"))
            for dim in np.unique(size).tolist():
                row, a = vectors(batch.column("va"), dim)
                also, b = vectors(batch.column("vb"), dim)
                both, i, j = np.intersect1d(row, also, assume_unique=True, return_indices=True)
                at = pa.array(both)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(cosines(a[i], b[j], near))], names=["a", "b", "cosine"])

    return pairs.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, cosine double")


def _cores(classes: DataFrame, m: int, seed: int, cosine: float) -> Stored:
    """``id, core``: classes within half the greatest angle of a centre, by the least number of such a centre."""
    keyed = _buckets(classes, 0, CORE_TABLES, m + CORE_FINER, seed + 7, False)
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("centre")).where(F.col("n") >= CROWDED).select("key", "centre")
    met = Stored(keyed.join(crowded, "key").select("id", "centre").distinct(), "met")
    half = math.cos(math.acos(cosine) / 2 - 1e-9)
    v = classes.select(F.col("id").alias("i"), F.col("label").alias("l"), F.col("v"))
    kind = classes.schema["v"].dataType

    def near(pairs: DataFrame, centre_vectors: DataFrame) -> DataFrame:
        member = pairs.join(v.withColumnRenamed("v", "va"), F.col("id") == F.col("i")).select("id", "centre", "va", "l")
        both = member.join(centre_vectors, "centre").where("l = cl").select(F.col("id").alias("a"), F.col("centre").alias("b"), "va", "vb")
        return _pair_cosines(both, kind, half).where(F.col("cosine") >= half).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("core"))

    own = met.df.select("centre").distinct().join(v, F.col("centre") == F.col("i")).select("centre", F.col("l").alias("cl"), F.col("v").alias("vb"))
    rough = Stored(near(met.df, own), "rough-cores")
    # The mean of a rough core is a better centre than any member; its candidates are those that met the old one
    # or the core that the old one itself went to.
    means = _means(rough.df.join(v, F.col("id") == F.col("i")).select("core", "l", "v"))
    means = means.select(F.col("core").alias("centre"), F.col("l").alias("cl"), "vb")
    means = Stored(means, "centres")
    moved = rough.df.select(F.col("id").alias("centre"), "core")
    also = met.df.join(moved, "centre").select("id", F.col("core").alias("centre"))
    cores = Stored(near(met.df.unionByName(also).distinct(), means.df), "cores")
    for t in (met, rough, means):
        t.drop()
    return cores


def _means(rows: DataFrame) -> DataFrame:
    """``core, l, vb``: the sum of the directions of each core's vectors, exact in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str, int], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            at = [(c, l, i) for (c, l, dim) in held for i in range(dim)]
            total = np.concatenate([*held.values(), np.zeros(0)]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in at], pa.int64()), pa.array([x[1] for x in at], pa.string()), pa.array([x[2] for x in at], pa.int32()), pa.array(total)], names=["core", "l", "part", "total"])

        for batch in few_rows(batches):
            core, label = _longs(batch.column("core")), batch.column("l")
            for row, x in _by_dimension(batch):
                x = _whole_directions(x)
                one, first, which = np.unique(core[row], return_index=True, return_inverse=True)
                order = np.argsort(which, kind="stable")
                sums = np.add.reduceat(x[order], np.searchsorted(which[order], np.arange(len(one))), axis=0)
                for c, f, s in zip(one.tolist(), row[first].tolist(), sums):
                    k = (c, label[f].as_py(), x.shape[1])
                    held[k] = held[k] + s if k in held else s
            if len(held) > 4096:
                yield out()
                held.clear()
        if held:
            yield out()

    parts = rows.mapInArrow(run, "core long, l string, part int, total long").groupBy("core", "l", "part").agg(F.sum("total").cast("double").alias("total"))
    whole = parts.groupBy("core", "l").agg(F.array_sort(F.collect_list(F.struct("part", "total"))).alias("p"))
    return whole.select("core", "l", F.transform("p", lambda x: x["total"]).alias("vb"))


def _dealt(keyed: DataFrame, block: int) -> tuple[DataFrame, list[Stored]]:
    """Rows with ``sub, side``: members of one bucket and ``sub`` are compared unless they share a side other than 0.

    A large bucket is cut into blocks.  The members of its largest core need not meet each other, so they
    only meet the blocks of the others; those also meet among themselves.
    """
    counts = Stored(keyed.groupBy("key", "core").agg(F.count("*").alias("n")), "bucket-sizes")
    large = counts.df.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.when(F.col("core") >= 0, F.struct("n", "core"))).alias("top")).where(F.col("n") > block)
    in_core = F.coalesce(F.col("top.n"), F.lit(0))
    cut = F.lit(float(block))
    large = Stored(large.select("key", F.col("top.core").alias("top"), F.ceil(in_core / cut).alias("kc"), F.ceil((F.col("n") - in_core) / cut).alias("ko")), "large-buckets")
    rows = keyed.join(large.df, "key", "left")
    mine = F.col("core").eqNullSafe(F.col("top"))
    at = F.pmod(F.xxhash64("id"), F.when(mine, F.col("kc")).otherwise(F.col("ko")))
    # A pair of blocks (i <= j) of others is 1 + i * ko + j; of core block c and other block i it is -1 - (c * ko + i).
    one = F.array(F.struct(F.lit(0).cast("long").alias("sub"), F.lit(0).alias("side")))

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))

    def place(sub, side):
        return F.struct(sub.cast("long").alias("sub"), side.cast("int").alias("side"))

    ko, kc = F.col("ko"), F.col("kc")
    core_rows = F.transform(upto(ko), lambda i: place(-1 - (at * ko + i), F.lit(1)))
    others = F.transform(upto(ko), lambda j: place(1 + F.least(at, j) * ko + F.greatest(at, j), F.when(j == at, 0).when(j > at, 1).otherwise(2)))
    with_core = F.transform(upto(kc), lambda c: place(-1 - (c * ko + at), F.lit(2)))
    places = F.when(ko.isNull(), one).when(mine, core_rows).otherwise(F.concat(others, with_core))
    out = rows.withColumn("p", F.explode(places)).select("key", "id", "core", "s0", "s1", F.col("p.sub").alias("sub"), F.col("p.side").alias("side"))
    return out, [counts, large]


def _meet(part: dict[str, np.ndarray], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of one bucket (a run of equal ``key, sub``) whose signs differ in few places."""
    key, sub = part["key"], part["sub"]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])]))
    size = np.diff(np.concatenate([starts, [len(key)]]))

    def passing(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # bitwise_count takes the size of signed numbers, so the bits are viewed as unsigned.
        s0, s1 = (part[s][i] ^ part[s][j] for s in ("s0", "s1"))
        near = np.bitwise_count(s0.view(U64)) + np.bitwise_count(s1.view(U64)) <= limit
        near &= (part["id"][i] != part["id"][j]) & ((part["core"][i] != part["core"][j]) | (part["core"][i] < 0))
        near &= (part["side"][i] != part["side"][j]) | (part["side"][i] == 0)
        return i[near], j[near]

    # Small buckets all at once, by the distance of their members; large ones row by row.
    small = np.repeat(size <= 64, size)
    left = np.repeat(starts + size, size) - np.arange(len(key))
    for d in range(1, min(64, int(size.max(initial=0)))):
        i = np.flatnonzero(small & (left > d))
        if len(i):
            yield passing(i, i + d)
    for a, n in zip(starts[size > 64].tolist(), size[size > 64].tolist()):
        for i in range(a, a + n - 1):
            j = np.arange(i + 1, a + n)
            yield passing(np.full(len(j), i), j)


def _candidates(dealt: DataFrame, limit: int) -> DataFrame:
    names = ["key", "sub", "id", "core", "s0", "s1", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(whole: pa.Table, to: int) -> Iterator[pa.RecordBatch]:
            part = {n: np.asarray(whole.column(n).slice(0, to).combine_chunks()).astype(np.int64) for n in names}
            found = list(_meet(part, limit)) if to else []
            if found:
                a, b = (part["id"][np.concatenate([f[k] for f in found])] for k in (0, 1))
                a, b = np.minimum(a, b), np.maximum(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 16:
                continue
            whole = pa.Table.from_batches(held)
            key, sub = np.asarray(whole.column("key")), np.asarray(whole.column("sub"))
            last = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))  # the last bucket may go on
            to = int(last[-1]) + 1 if len(last) else 0
            yield from out(whole, to)
            held = whole.slice(to).to_batches()
        if held:
            whole = pa.Table.from_batches(held)
            yield from out(whole, whole.num_rows)

    rows = dealt.select(*names).repartition("key", "sub").sortWithinPartitions("key", "sub")
    return rows.mapInArrow(run, "a long, b long").distinct()


def near_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    seed: int = 13,
    block: int = BLOCK,
    crowded_tables: bool = True,
) -> DataFrame:
    """Add ``n_links`` (other vectors of the label with at least this cosine that were found), ``component_id`` (the least
    key that links lead to) and ``kept`` (the key is that one) to every row.

    No link below ``cosine`` is made.  A pair at just that cosine is missed with a chance of about :data:`MISSED`, nearer
    pairs much more rarely; vectors that are equal are always linked.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
    nothing: no links, their own key.  Vectors of different lengths do not link.  Rows are vectors: repeated ones
    link with each other, also if they share a key.  Keys may be of any type that can be ordered; a component's key is
    the least that is not null, and ``kept`` compares null-safe, so all rows of a component without any key stay.
    Other columns are kept; columns with the names of new ones are replaced.  An empty table gives an empty one.
    """
    spark = df.sparkSession
    kept = df.drop(*(c for c in ADDED if c not in (key, vector, label)))
    rows = kept.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("row"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("v"))
    named = _classes(rows)
    member = named.where("cls IS NOT NULL").select("cls", F.col(f"row.`{key}`").alias("k"), "label", "dim", "v")
    # A short row per vector settles the size of a class; the vector itself is fetched by a join with its first row.
    grouped = member.groupBy("cls").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    grp = F.xxhash64("label", "dim")
    first = Stored(grouped.select(F.monotonically_increasing_id().alias("id"), "cls", "n", "least", "label", "dim", grp.alias("grp"), F.lit(-1).cast("long").alias("core"), "v"), "vector-classes")
    largest = first.df.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    m, tables = shape(largest, cosine)

    found = _cores(first.df, m, seed, cosine) if crowded_tables else None
    classes = first
    if found is not None:
        with_core = first.df.drop("core").join(found.df, "id", "left").withColumn("core", F.coalesce("core", F.lit(-1)))
        classes = Stored(with_core.select(*first.df.columns), "classes-with-cores")

    met: DataFrame | None = None
    parts: list[Stored] = []
    for at in range(0, tables, TABLES):
        keyed = _buckets(classes.df, at, min(tables, at + TABLES), m, seed, True)
        dealt, used = _dealt(keyed, block)
        parts.append(Stored(_candidates(dealt, sign_limit(cosine)), "candidate-pairs"))
        met = parts[-1].df if met is None else met.unionByName(parts[-1].df)
        for t in used:
            t.drop()
        release(spark)
    v = classes.df.select("id", "label", "v")
    a = v.select(F.col("id").alias("a"), F.col("label").alias("la"), F.col("v").alias("va"))
    b = v.select(F.col("id").alias("b"), F.col("label").alias("lb"), F.col("v").alias("vb"))
    pairs = met.distinct().join(a, "a").join(b, "b").where("la = lb")
    links = Stored(_pair_cosines(pairs, classes.df.schema["v"].dataType, cosine).where(F.col("cosine") >= cosine).select("a", "b"), "vector-links")

    ways = links.df.unionByName(links.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = classes.df.select(F.col("id").alias("b"), F.col("n"))
    by_link = ways.join(n, "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    core = classes.df.where("core >= 0").groupBy("core").agg(F.sum("n").alias("in_core"), F.min("id").alias("first"))
    in_core = classes.df.where("core >= 0").join(core, "core").select("id", "in_core", "first")
    in_core = Stored(in_core, "core-members")
    reach = links.df.unionByName(in_core.df.select(F.col("first").alias("a"), F.col("id").alias("b")))
    roots = connected_components(reach)
    rooted = classes.df.select("id", "cls", "n", "least").join(roots.df.withColumnRenamed("node", "id"), "id", "left").join(in_core.df.select("id", "in_core"), "id", "left")
    rooted = rooted.join(by_link, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # Written first, so that a component with very many classes is split among tasks when it is joined.
    rooted = Stored(rooted.select("cls", "root", "least", (F.coalesce("in_core", "n") - 1 + F.coalesce("linked", F.lit(0))).alias("links")), "rooted-classes")
    least = Stored(rooted.df.groupBy("root").agg(F.min("least").alias("component")), "component-keys")
    result = Stored(rooted.df.join(least.df, "root").select("cls", "links", "component"), "class-results")
    for t in (*parts, links, in_core, roots, rooted, least, classes, *([first, found] if found is not None else [])):
        t.drop()
    release(spark)

    out = named.select("row", "cls").join(result.df, "cls", "left")
    own = F.col(f"row.`{key}`")
    component = F.when(F.col("links").isNull(), own).otherwise(F.col("component"))
    columns = [F.col(f"row.`{c}`") for c in kept.columns]
    return out.select(*columns, F.coalesce("links", F.lit(0)).cast("long").alias(ADDED[0]), component.alias(ADDED[1]), own.eqNullSafe(component).alias(ADDED[2]))
