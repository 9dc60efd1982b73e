"""Documents linked by the Jaccard similarity of their word shingles, and their groups.

1. Documents with equal sets form a class; everything below is about classes.
2. Likely links first: classes that share one of their few least shingles are compared with the least class of that
   shingle, and links that hold join classes into groups.  This is a shortcut only: it makes large groups of
   near copies one group before any pairs are made.
3. All other links: two sets that are similar enough share a shingle of their prefixes (their first shingles in one
   order of all shingles, so many that the rest alone could not reach the similarity).  Prefix shingles within one
   group need no work.  The others are tiles: (band of sizes, shingle).  Classes of different groups that meet in a
   tile are compared by size and by bitmap: bits hold the parity of the shingles hashed to them, so the number of
   bits that differ bounds the shingles that differ from below, and the overlap from above.
4. Pairs that pass are compared exactly, as sorted arrays; links join groups into components.

Prefixes order shingles by commonness, estimated on a bounded sample of documents: common ones come last and are
rarely in a prefix.  Any order finds all links; the sample affects the cost alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .stored import Stored, release
from .text_bytes import U64, distinct_shingles, row_chunks, seeded, words_of

SHINGLE = 5
#: Similarity, in hundredths.
PERCENT = 80
#: Least shingles by which likely links are found.
KEYS = 4
#: A least shingle of more classes than this has several classes drawn by lot to compare all others with.
CROWDED, DRAWN = 32, 24
#: Longs of the bitmaps of all sets, and of the further bitmaps of sets with over ``WIDE_FROM`` shingles.
NARROW, WIDE, WIDE_FROM = 8, 64, 600
#: Documents that the commonness of shingles is estimated on, and the share of them that makes a shingle common.
SAMPLE, COMMON = 5_000, 0.002
#: Ids up to this number are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _parity(shingles: np.ndarray, longs: int) -> np.ndarray:
    bit = (shingles >> U64(20)) % U64(longs * 64)
    odd = np.bincount(bit.astype(np.int64), minlength=longs * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _class(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(column: pa.Array, length: int) -> Iterator[np.ndarray]:
    w = words_of(column, lower=True)
    for a, b in zip(w.first[:-1], w.first[1:]):
        yield distinct_shingles(w.name[a:b], length)


def _lists(values: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))


def common_shingles(docs: DataFrame, length: int, sample: int = SAMPLE, share: float = COMMON) -> np.ndarray:
    """Shingles in at least ``share`` of about ``sample`` documents; at most the mean set size over ``share``."""
    rows = docs.count()
    if rows > sample:
        docs = docs.where(F.pmod(F.xxhash64(F.lit(11), "_doc"), F.lit(1 << 31)) < int(sample / rows * (1 << 31)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, "_text"):
            sets = list(_sets(batch.column("_text"), length))
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    least = max(4, int(min(rows, sample) * share))
    counts = docs.select("_text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counts.select("shingle").toArrow().column("shingle").to_numpy()
    return np.sort(found.astype(np.int64).view(U64))


def _describe(docs: DataFrame, common: np.ndarray, length: int, percent: int) -> DataFrame:
    """Per document: size and class of its set, least shingles, prefix and bitmaps."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in row_chunks(batches, "_text"):
            size, cls, keys, prefix, bits, wide = [], [], [], [], [], []
            for s in _sets(batch.column("_text"), length):
                size.append(len(s)), cls.append(_class(s) if len(s) else None)
                keys.append(s[:KEYS])
                often = np.isin(s, common, assume_unique=True) if len(common) else np.zeros(len(s), bool)
                n = len(s) + (percent * len(s)) // -100 + 1 if len(s) else 0
                prefix.append(np.concatenate([s[~often], s[often]])[:n])
                bits.append(_parity(s, NARROW))
                wide.append(_parity(s, WIDE) if len(s) > WIDE_FROM else np.zeros(0, np.int64))
            arrays = [batch.column("_doc"), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), *map(_lists, (keys, prefix, bits, wide))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_doc", "size", "cls", "keys", "prefix", "bits", "wide"])

    schema = "_doc long, size long, cls long, keys array<long>, prefix array<long>, bits array<long>, wide array<long>"
    return docs.select("_doc", "_text").mapInArrow(run, schema)


def _apart(a: Column, b: Column) -> Column:
    differ = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differ, F.lit(0), lambda s, x: s + x)


def _may_link(percent: int) -> Column:
    """Size and bitmap tests of two described classes, ``x`` and ``y``; true for all pairs that are similar enough."""
    n, m = F.col("x.size"), F.col("y.size")
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    # With d shingles in one set only, the overlap is (n + m - d) / 2 and the union (n + m + d) / 2.
    near = lambda d: (100 + percent) * d <= (100 - percent) * (n + m)
    wide = (F.size("x.wide") == 0) | (F.size("y.wide") == 0) | near(_apart(F.col("x.wide"), F.col("y.wide")))
    return sizes & near(_apart(F.col("x.bits"), F.col("y.bits"))) & wide


def _narrow_test(s: str, t: str, percent: int) -> Column:
    """Size and narrow bitmap tests of two structs with ``size, b0, b1 ...``."""
    n, m = F.col(f"{s}.size"), F.col(f"{t}.size")
    differ = sum((F.bit_count(F.col(f"{s}.b{i}").bitwiseXOR(F.col(f"{t}.b{i}"))) for i in range(NARROW)), F.lit(0))
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _drawn_pairs(byte: DataFrame, crowded: DataFrame, outline: DataFrame, percent: int) -> Stored:
    """In each crowded shingle, pairs ``a, b`` of a few classes drawn by lot with all others that may link with them.

    A large group of near copies, few of which need resemble any one of it, falls into one group by these links
    with a number of comparisons in proportion to its size.  The lots: the class nearest to a fixed number.
    """
    rows = Stored(byte.join(crowded, "key", "left_semi"), "crowded-shingles")
    marks = seeded(DRAWN, 13).view(np.int64).tolist()
    nearest = [F.min(F.col("cls").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)) for m in marks]
    drawn = rows.df.groupBy("key").agg(*(n.alias(f"d{i}") for i, n in enumerate(nearest)))
    drawn = drawn.select("key", F.explode(F.array_distinct(F.array(*(f"d{i}" for i in range(DRAWN))))).alias("member"))
    flat = F.struct("cls", "size", *(F.col("bits")[i].alias(f"b{i}") for i in range(NARROW)))
    described = outline.select(F.col("cls").alias("member"), flat.alias("row"))
    centres = Stored(drawn.join(described, "member").select("key", F.col("row").alias("s")), "drawn-classes")
    others = rows.df.withColumnRenamed("cls", "member").join(described, "member").select("key", F.col("row").alias("t"))
    near = others.join(centres.df, "key").where((F.col("s.cls") != F.col("t.cls")) & _narrow_test("s", "t", percent))
    out = Stored(near.select(F.col("s.cls").alias("a"), F.col("t.cls").alias("b")).distinct(), "drawn-pairs")
    rows.drop()
    centres.drop()
    return out


def _verified(pairs: DataFrame, docs: DataFrame, least: DataFrame, length: int, percent: int) -> Stored:
    """Those of ``pairs(a, b)`` of classes whose sets are similar enough, by exact intersection.

    ``least(cls, _doc)`` names a document of each class.
    """
    pairs = Stored(pairs, "pairs")
    needed = pairs.df.select(F.col("a").alias("cls")).unionByName(pairs.df.select(F.col("b").alias("cls"))).distinct()
    ids = Stored(least.select("cls", "_doc").join(needed, "cls", "left_semi"), "needed-ids")
    chosen = ids.df.select("_doc").distinct()
    if ids.df.count() <= BROADCAST_IDS:  # either way the same rows
        chosen = F.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, "_text"):
            sets = list(_sets(batch.column("_text"), length))
            arrays = [pa.array([_class(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["cls", "shingles"])

    texts = docs.select("_doc", "_text").join(chosen, "_doc", "left_semi").select("_text")
    sets = Stored(texts.mapInArrow(run, "cls long, shingles binary").join(ids.df.select("cls"), "cls", "left_semi"), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), dtype=U64), np.frombuffer(y.as_py(), dtype=U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.df.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    y = sets.df.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    out = Stored(pairs.df.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")
    for t in (pairs, ids, sets):
        t.drop()
    release(docs.sparkSession)
    return out


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = SHINGLE, percent: int = PERCENT, size: str = "n_shingles", component: str = "component_id") -> DataFrame:
    """Add the number of distinct shingles and the least ``key`` among the documents that links lead to.

    Two documents link when 100 times the shingles they share is at least ``percent`` times the shingles of
    either.  A text with fewer than ``length`` words is one shingle; null texts and texts without words have
    none, link with nothing and keep their own key.  Rows without a key take part like others but do not name
    a component: theirs is null if no row in it has a key.  All rows and other columns are kept; columns
    with a new one's name are replaced.  Documents are described once and joined to their components by key,
    with a copy's class as tie-break, so rows with one key and different texts stay apart.
    """
    base = docs.drop(size, component)
    keyed = base.withColumns({"_doc": F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)), "_text": F.coalesce(F.col(text), F.lit(""))})
    groups = component_table(keyed.select("_doc", "_text"), length, percent)
    return _attach(base, keyed, groups, length, size, component)


def component_table(docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> Stored:
    """``_doc, size, cls, component`` for ``docs(_doc, _text)``; one row per document, without texts."""
    spark = docs.sparkSession
    described = Stored(_describe(docs, common_shingles(docs, length), length, percent).withColumn("_row", F.monotonically_increasing_id()), "described")
    documents = Stored(described.df.select("_doc", "size", "cls"), "document-classes")
    # One row describes each class: that of its least document.
    least = described.df.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("_doc", "_row")).alias("r")).select("cls", "r._doc", "r._row")
    least = Stored(least, "classes")
    classes = Stored(described.df.drop("_doc").join(least.df.select("_row"), "_row", "left_semi").drop("_row"), "class-sets")
    described.drop()
    release(spark)
    outline = Stored(classes.df.select("cls", "size", "bits", "wide"), "class-bitmaps")
    side = F.struct("cls", "size", "bits", "wide")

    # Likely links: each class and the least class of each of its least shingles.
    byte = classes.df.select(F.explode("keys").alias("key"), "cls")
    # Written before the join, so that Spark can split the rows of a common shingle among tasks; so below.
    centre = Stored(byte.groupBy("key").agg(F.min("cls").alias("a"), F.count("*").alias("n")).where("n > 1"), "centres")
    likely = byte.join(centre.df, "key").where("a <> cls").select("a", F.col("cls").alias("b")).distinct()
    x, y = outline.df.select(F.col("cls").alias("a"), side.alias("x")), outline.df.select(F.col("cls").alias("b"), side.alias("y"))
    likely = likely.join(x, "a").join(y, "b").where(_may_link(percent)).select("a", "b")
    drawn = _drawn_pairs(byte, centre.df.where(F.col("n") > CROWDED).select("key"), outline.df, percent)
    likely = likely.unionByName(drawn.df).distinct()
    first_links = _verified(likely, docs, least.df, length, percent)
    first_groups = connected_components(first_links.df)

    # Tiles with classes of two groups or more.
    bits = [F.col("bits")[i].alias(f"b{i}") for i in range(NARROW)]
    sizes = classes.df.select("cls", "size", *bits).join(first_groups.df.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    sizes = Stored(sizes, "class-groups")
    rooted = Stored(classes.df.select("cls", "prefix").join(sizes.df.select("cls", "root"), "cls").select("prefix", "cls", "root"), "prefixes")
    classes.drop()
    mixed = rooted.df.select(F.explode("prefix").alias("shingle"), "root").groupBy("shingle").agg(F.min("root").alias("p"), F.max("root").alias("q"))
    mixed = Stored(mixed.where("p <> q").select("shingle"), "mixed-shingles")
    tiles = rooted.df.select(F.explode("prefix").alias("shingle"), "cls").join(mixed.df, "shingle", "left_semi").join(sizes.df, "cls")
    tiles = Stored(tiles, "tiles")
    rooted.drop()
    mixed.drop()
    release(spark)
    # Sizes of similar sets lie in one band or in two neighbouring ones (a band is a little wider than the ratio allowed).
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.01 / percent)))
    row = F.struct("cls", "root", "size", *(f"b{i}" for i in range(NARROW)))
    small = tiles.df.select("shingle", band.alias("band"), row.alias("s"))
    large = tiles.df.select("shingle", F.explode(F.array(band, band - 1)).alias("band"), row.alias("l"))
    meet = (F.col("s.root") != F.col("l.root")) & (100 * F.col("s.size") >= percent * F.col("l.size"))
    meet &= (F.col("s.size") < F.col("l.size")) | ((F.col("s.size") == F.col("l.size")) & (F.col("s.cls") < F.col("l.cls")))
    # The bitmaps are compared inside the join, so a tile of many unlike classes makes no rows.
    meet &= _narrow_test("s", "l", percent)
    pairs = small.join(large, ["shingle", "band"]).where(meet).select(F.col("s.cls").alias("a"), F.col("l.cls").alias("b")).distinct()
    pairs = pairs.join(x, "a").join(y, "b").where(_may_link(percent)).select("a", "b")
    links = _verified(pairs, docs, least.df, length, percent)
    for t in (tiles, sizes, outline):
        t.drop()

    every = first_links.df.unionByName(links.df)
    roots = connected_components(every)
    named = least.df.select("cls", "_doc").join(roots.df.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    component = named.groupBy("root").agg(F.min("_doc").alias("component"))
    by_class = Stored(named.join(component, "root").select("cls", "component"), "class-components")
    out = documents.df.join(by_class.df, "cls", "left")
    out = Stored(out.select("_doc", "size", "cls", F.coalesce("component", "_doc").alias("component")), "document-components")
    for t in (documents, least, centre, drawn, first_links, first_groups, links, roots, by_class):
        t.drop()
    release(spark)
    return out


def _attach(base: DataFrame, keyed: DataFrame, groups: Stored, length: int, size: str, component: str) -> DataFrame:
    """The rows of ``base`` with the columns of their group."""
    columns = list(base.columns)
    none = F.lit((1 << 63) - 1)
    fresh = groups.df.select("_doc", "cls", "size", "component").distinct()
    clash = fresh.groupBy("_doc").count().where("count > 1")
    named = [F.col("size").alias(size), F.when(F.col("component") != none, F.col("component")).alias(component)]
    if clash.isEmpty():
        return keyed.join(fresh, "_doc").select(*(F.col(f"`{c}`") for c in columns), *named)

    # Some key has several texts: rows are told apart by the class of their text.
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema] + ["_cls long"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, "_text"):
            cls = [_class(s) if len(s) else None for s in _sets(batch.column("_text"), length)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls, pa.int64())], names=[*batch.schema.names, "_cls"])

    rows = keyed.mapInArrow(run, ", ".join(fields)).withColumnRenamed("_doc", "_own")
    out = rows.join(fresh, (F.col("_own") == F.col("_doc")) & F.col("_cls").eqNullSafe(F.col("cls")))
    return out.select(*(F.col(f"`{c}`") for c in columns), *named)
