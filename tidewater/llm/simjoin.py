"""Grouped prefix join: documents whose shingle sets have a Jaccard similarity of 0.75 or more.

Two sets that similar share a shingle among the first ``n - ceil(t n) + 1`` of
each, in any order common to all sets.  The order puts rare shingles first, by
the counters of a sketch of the whole corpus, so that passages in many documents
seldom make candidates.

1. Documents with equal sets are one *set*; sets with equal prefix and size are
   one *group*.  Only groups meet in the index.
2. Each posting list that has several groups proposes a few pairs per group,
   with its pivots; verified pairs are links, links make components.  Lists that
   still have several components are tried again with other pivots, as long as
   that links enough of them.  A large family of near copies falls into one
   component by a few times as many pairs as it has members, not by all its pairs.
3. What is left are pairs of groups in different components, each with a shared
   element.  They pass filters on size, position, a bitmap of either set and the
   number of shared prefix elements, are expanded to sets, and are verified exactly.
   Pairs inside one component need no check: they could not change it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize
from .graph import components
from .rolling import U64, mix
from .shingles import WIDTH, shingle_sets

THRESHOLD_PERCENT = 75
#: The sketch has this many counters, whatever the corpus: 4 MB.
SKETCH_BITS = 20
_CHUNK_BITS = 14
#: Pivots of a posting list in each round, besides its most central group in the first.
PIVOTS = 2
#: Another round follows while the last one linked at least this share of the groups that were open.
WORTH_A_ROUND = 0.02
#: Words of the bitmap of a set, of 64 bits each.
BITMAP_WORDS = 8


def frequency_sketch(docs: DataFrame, text_col: str = "text", width: int = WIDTH) -> np.ndarray:
    """Counters of all shingles of all documents, by hash: each task sends one array, in compressed chunks that are summed in two steps."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(size, np.int64), 0
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), width))
            if sets:
                h = np.concatenate(sets)
                total += np.bincount((h & U64(size - 1)).astype(np.int64), minlength=size)
                part ^= int(h[0] >> U64(40)) if len(h) else 0
        if total.any():
            chunks = total.astype("<u4").reshape(-1, 1 << _CHUNK_BITS)
            yield pa.record_batch({"chunk": pa.array(range(len(chunks)), pa.int32()), "part": pa.array([part % 64] * len(chunks), pa.int32()), "n": pa.array([zlib.compress(c.tobytes(), 1) for c in chunks], pa.binary())})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(1 << _CHUNK_BITS, np.int64)
        for x in table.column("n"):
            total += np.frombuffer(zlib.decompress(x.as_buffer()), "<u4")
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "n": pa.array([zlib.compress(np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes(), 1)], pa.binary())})

    schema = "chunk int, part int, n binary"
    parts = docs.select(text_col).mapInArrow(count, schema)
    sums = parts.groupBy("chunk", "part").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    out = np.zeros((size >> _CHUNK_BITS, 1 << _CHUNK_BITS), np.uint32)
    for row in sums.collect():  # the whole sketch, of fixed size: one row a chunk, in one job rather than one a partition
        out[row.chunk] = np.frombuffer(zlib.decompress(row.n), "<u4")
    return out.reshape(-1)


def in_order(hashes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """A sorted set by the counters of its shingles, rare ones first; ties stay in order."""
    return hashes[np.argsort(sketch[(hashes & U64(len(sketch) - 1)).astype(np.int64)], kind="stable")]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles in each of a few hundred places, as 64-bit words.

    Places where two sets differ are at most as many as the shingles that only one of them has.
    """
    at = (hashes >> U64(64 - 6) << U64(3) | hashes >> U64(20) & U64(7)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * BITMAP_WORDS) & 1).astype(np.uint8)).view(np.int64)


def prefix_length(n: int, percent: int = THRESHOLD_PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _id(parts: np.ndarray) -> int:
    """A 64-bit name of an array of hashes, order included."""
    place = np.arange(1, len(parts) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    return int(mix(mix(parts ^ place).sum(keepdims=True) + U64(len(parts))).view(np.int64)[0])


_BITS = [f"b{i}" for i in range(BITMAP_WORDS)]


def document_sets(docs: DataFrame, sketch: np.ndarray, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Per document: a hash of its text, the name of its set (null if empty), the set's size and bitmap, the name of its group and its prefix."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, sizes, groups, prefixes = [], [], [], []
        bits = np.zeros((batch.num_rows, BITMAP_WORDS), np.int64)
        for row, s in enumerate(shingle_sets(batch.column(1), width)):
            n = len(s)
            sizes.append(n)
            if not n:
                names.append(None), groups.append(None), prefixes.append(None)
                continue
            p = in_order(s, sketch)[: prefix_length(n, percent)]
            names.append(_id(s))
            groups.append(_id(np.append(p, U64(n))))
            prefixes.append(p.view(np.int64))
            bits[row] = bitmap(s)
        return pa.record_batch({
            "id": batch.column(0), "h": batch.column(2), "set_id": pa.array(names, pa.int64()), "n": pa.array(sizes, pa.int64()),
            "group_id": pa.array(groups, pa.int64()), "prefix": pa.array(prefixes, pa.list_(pa.int64())), **{c: pa.array(bits[:, i]) for i, c in enumerate(_BITS)},
        })

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col, F.xxhash64(text_col)), run, f"id {kind}, h long, set_id long, n long, group_id long, prefix array<long>, " + ", ".join(f"{c} long" for c in _BITS))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs of sets ``(a, b)``, those similar enough."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        left, right = batch.column(2), batch.column(3)
        lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
        lv, rv = left.values.to_numpy(), right.values.to_numpy()
        for i in range(batch.num_rows):
            x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
            both = np.sort(np.concatenate((x, y)))
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y")), "b")
    return map_arrow(joined.select("a", "b", "x", "y"), run, "a long, b long")


def _alike(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of sizes ``n`` and ``m`` that share their elements ``i`` and ``j`` can be similar enough: fewer are shared before and after than either has."""
    most = F.least(i, j) + F.least(n - i, m - j)
    return (most * (100 + percent) >= percent * (n + m)) & (F.least(n, m) * 100 >= percent * F.greatest(n, m))


def _bits_alike(left: list[str], right: list[str], percent: int) -> Column:
    """Whether the bitmaps of two sets (null if unknown) leave room for enough shared elements."""
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(left, right)), F.lit(0))
    # 2 * shared <= n + m - apart, and shared * (100 + percent) >= percent * (n + m)
    return F.coalesce((F.col("n") + F.col("m") - apart) * (100 + percent) >= 2 * percent * (F.col("n") + F.col("m")), F.lit(True))


def _counted(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups ``(g, h)`` from one row per shared prefix element, if they share enough of them.

    Of two prefixes, the one that ends first in the common order has all its
    shared elements in both; what is shared beyond lies in the rest of its set.
    """
    rest = lambda n: F.ceil(n * percent / 100) - 1
    pairs = shared.groupBy("g", "h").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    return pairs.filter((F.col("c") + F.greatest(rest(F.col("n")), rest(F.col("m")))) * (100 + percent) >= percent * (F.col("n") + F.col("m"))).select("g", "h")


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id)`` for every row of ``docs``.

    The component is the smallest id that a document reaches over links of the
    given similarity, itself included.

    Defined cases: a null, empty or blank text has an empty set and is its own
    component; repeated rows and equal texts fall together; a null id takes part
    in linking but never names a component that has another id; very long texts
    are read whole; other columns are not read, so their names cannot clash; an
    empty table gives an empty one.
    """
    labelled = _labelled(docs.select(id_col, text_col), percent, width, id_col, text_col)
    least = labelled.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("id").alias("least"))
    return labelled.join(least, "label", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _labelled(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id, h, n, label`` per document: a hash of its text, the size of its set and the name of its component, null without a set."""
    sketch = frequency_sketch(docs, text_col, width)
    wide = materialize(document_sets(docs, sketch, id_col, text_col, width, percent), "sets")
    docs_sets = materialize(wide.select("id", "h", "set_id", "n", "group_id"), "sets")
    filled = wide.filter("set_id is not null")
    members = materialize(filled.groupBy("set_id").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("group_id", *_BITS)]), "members")
    index = posting_lists(wide)
    discard(wide)
    labels = set_labels(members, index, docs, percent, width, id_col, text_col)
    discard(members)
    return docs_sets.join(labels, "set_id", "left").select("id", "h", "n", F.coalesce("label", "set_id").alias("label"))


def posting_lists(docs_sets: DataFrame) -> DataFrame:
    """``token, group_id, n, i``: the groups whose prefix has each token, with their size and the token's place, for tokens of several groups; the rest can propose nothing."""
    groups = docs_sets.filter("set_id is not null").groupBy("group_id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    posted = groups.select("group_id", "n", F.posexplode("prefix").alias("i", "token")).select("token", "group_id", "n", F.col("i").cast("long").alias("i"))
    return materialize(_repeated(posted.repartition("token").sortWithinPartitions("token")), "postings")


def _with_pivots(index: DataFrame, seeds: list[int], central: bool, percent: int) -> DataFrame:
    """Pairs of groups ``g, h`` from every posting and its token's pivots, a row per token.

    A pivot is the group whose hash under a seed is the least, so that a family's
    lists agree on it, or the group that has least before the token, for that one
    resembles a family's original.
    """
    row = lambda *first: F.min(F.struct(*first, "group_id", "n", "i", "label")).cast("struct<r:bigint,s:bigint,group_id:bigint,n:bigint,i:bigint,label:bigint>")
    chosen = [row(F.xxhash64("group_id", F.lit(k)).alias("r"), F.lit(0).cast("long").alias("s")) for k in seeds]
    if central:
        chosen.append(row(F.col("i").alias("r"), F.xxhash64("group_id").alias("s")))
    pivots = index.groupBy("token").agg(F.array(*chosen).alias("p"))
    one = lambda p: F.struct(p["group_id"].alias("h"), p["n"].alias("m"), p["i"].alias("j"), p["label"].alias("hl"))
    pivots = pivots.select("token", F.explode(F.array_distinct(F.transform("p", one))).alias("p")).select("token", "p.*")
    return index.withColumnRenamed("group_id", "g").join(pivots, "token").filter((F.col("label") != F.col("hl")) & _alike(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent))


def set_labels(members: DataFrame, index: DataFrame, docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """``set_id, label``: the component of every set that is linked with another."""
    of_group = members.select("group_id", "set_id")

    def expand(pairs: DataFrame) -> DataFrame:
        """Pairs of groups to pairs of their sets."""
        x = pairs.join(of_group.select(F.col("group_id").alias("g"), F.col("set_id").alias("sa")), "g")
        x = x.join(of_group.select(F.col("group_id").alias("h"), F.col("set_id").alias("sb")), "h")
        return x.filter("sa != sb").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.distinct(), "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(members.select("set_id", "id"), "set_id")
        sets = materialize(_sets_of(wanted, docs, width, id_col, text_col), "hashes")
        out = materialize(_verified(pairs, sets, percent), "found")
        discard(pairs), discard(sets)
        return out

    def merged(named: DataFrame, links: DataFrame) -> DataFrame:
        """Sets with their components after further links between them."""
        of = lambda end: named.select(F.col("set_id").alias(end), F.col("label").alias(f"l{end}"))
        between = links.join(of("a"), "a").join(of("b"), "b").filter("la != lb")
        new = components(between, "la", "lb").select(F.col("node").alias("label"), F.col("label").alias("to"))
        out = materialize(named.join(new, "label", "left").select("group_id", "set_id", F.coalesce("to", "label").alias("label")), "labels")
        discard(named), discard(links)
        return out

    def still_open(index: DataFrame, named: DataFrame) -> DataFrame:
        """Postings with their groups' components, where the token has several.  A group whose sets lie in several is a component of its own here."""
        one = named.groupBy("group_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        one = one.select("group_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("group_id")).alias("label"))
        here = index.select("token", "group_id", "n", "i").join(one, "group_id")
        several = here.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("token")
        out = materialize(here.join(several, "token", "left_semi"), "open")
        discard(index)
        return out

    # every group against the pivots of its tokens, and every set against the least of its group
    several = of_group.groupBy("group_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).filter("a != z")
    inside = of_group.join(several, "group_id").filter("a != set_id").select("a", F.col("set_id").alias("b"))
    tried = _with_pivots(index.withColumn("label", F.col("group_id")), list(range(PIVOTS)), True, percent)
    found = verified(expand(_counted(tried, percent)).unionByName(inside))
    named = merged(materialize(of_group.withColumn("label", F.col("set_id")), "labels"), found)
    # groups in different components, with other pivots
    here, rounds = still_open(index, named), 1
    while True:
        groups = here.select("group_id").distinct().count()
        if not groups:
            break
        seeds = list(range(PIVOTS * rounds, PIVOTS * (rounds + 1)))
        found = verified(expand(_counted(_with_pivots(here, seeds, False, percent), percent)))
        linked = found.count()
        named, rounds = merged(named, found), rounds + 1
        here = still_open(here, named)
        if linked < WORTH_A_ROUND * groups:
            break

    # all that is left: of each token, the groups outside its largest component against all others
    sizes = here.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("top"))
    single = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("k"), *[F.first(c).alias(c) for c in _BITS])
    single = single.select("group_id", *[F.when(F.col("k") == 1, F.col(c)).alias(c) for c in _BITS])
    rows = here.join(largest, "token").join(single, "group_id").withColumn("minor", F.col("label") != F.col("top")).drop("top")
    rows = materialize(rows, "rest")
    left = rows.filter("minor").drop("minor").withColumnRenamed("group_id", "g")
    right = rows.select(F.col("token"), F.col("group_id").alias("h"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("label").alias("hl"), "minor", *[F.col(c).alias(f"h{c}") for c in _BITS])
    once = ~F.col("minor") | (F.col("g") < F.col("h"))
    near = _alike(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent) & _bits_alike(_BITS, [f"h{c}" for c in _BITS], percent)
    met = left.join(right, "token").filter((F.col("label") != F.col("hl")) & once & near)
    met = met.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), F.when(F.col("g") < F.col("h"), F.col("n")).otherwise(F.col("m")).alias("n"), F.when(F.col("g") < F.col("h"), F.col("m")).otherwise(F.col("n")).alias("m"))
    parted = named.groupBy("group_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("group_id")
    parted = named.join(parted, "group_id", "left_semi")
    other = parted.select("group_id", F.col("set_id").alias("b"), F.col("label").alias("bl"))
    within = parted.withColumnRenamed("set_id", "a").join(other, "group_id").filter("a < b and label != bl").select("a", "b")
    found = verified(expand(_counted(met, percent)).unionByName(within))
    discard(here), discard(rows)
    return merged(named, found).select("set_id", "label")


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows, sorted by their token in each partition, whose token the row before or after also has.  One row is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shown = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column(0).to_numpy()
            same = t[1:] == t[:-1]
            keep = np.zeros(len(t), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None and last.column(0)[0].as_py() == t[0]:
                keep[0] = True
                if not shown:
                    yield last
            yield batch.filter(pa.array(keep))
            last, shown = batch.slice(batch.num_rows - 1), bool(keep[-1])

    return rows.mapInArrow(run, rows.schema)


def _sets_of(members: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(set_id, hashes)`` of the sets in ``members``, from the text of one document each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = list(shingle_sets(batch.column(1), width))
        keep = [i for i, (s, want) in enumerate(zip(made, batch.column(0).to_pylist())) if len(s) and _id(s) == want]
        return pa.record_batch({"set_id": batch.column(0).take(pa.array(keep, pa.int64())), "hashes": pa.array([made[i].view(np.int64) for i in keep], pa.list_(pa.int64()))})

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = members.select("id", "set_id").join(texts, members.id.eqNullSafe(texts.id)).select("set_id", "text")
    # ids may repeat: only a text that gives the set counts, and one of those is enough
    return map_arrow(named, run, "set_id long, hashes array<long>").dropDuplicates(["set_id"])


def keep_one(docs: DataFrame, percent: int = THRESHOLD_PERCENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id, and of its texts the one with the smallest hash, once.

    A null id comes last; rows without a set (null, empty or blank texts) are all
    kept, equal ones once.
    """
    labelled = _labelled(docs.select(id_col, text_col), percent, width, id_col, text_col)
    # rows with the same id, or none, are told apart by their text; a row without a set is its own component
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("f")
    chosen = labelled.filter("label is not null").groupBy("label").agg(first).select("f.id", "f.h")
    chosen = materialize(chosen.unionByName(labelled.filter("label is null").select("id", "h").distinct()), "kept")
    marked = docs.withColumn("_h", F.xxhash64(text_col))
    kept = marked.join(chosen, marked[id_col].eqNullSafe(chosen["id"]) & (marked["_h"] == chosen["h"]), "left_semi")
    return kept.dropDuplicates([id_col, "_h"]).drop("_h")
