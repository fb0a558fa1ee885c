"""MinHash near-dedup: bottom-k sketches from one hash function.

A document's set holds its distinct five-word shingles as 64-bit hashes; its
sketch holds the ``K`` smallest. Documents are linked when 100 * intersection
>= 75 * union, checked on the full sets.

1. Equal sets become one class, represented by its smallest doc_id.
2. Inverted lists of retained values. Linked sets share ``NEED`` sketch values
   at least (all but about 2e-9 of pairs right at the threshold, by the
   binomial tail, fewer above it; sets up to 32 shingles always). A value that
   one class alone retains shares nothing; in the order from rare to common a
   class has to be listed only under its first x - need + 1 values out of the x
   that others retain too, and not at all with fewer than ``need``. So common
   lines and passages neither list a document nor make long lists.
3. Overlaps: the members of each list are compared with ``PIVOTS`` of them,
   which takes as many pairs for each entry however long the list is. Lists
   whose members then form one component are done, as no further link can
   change the result. Of the others, lists of up to ``SHORT`` members are
   compared in full. The members of longer ones are listed anew by their full
   sets, where the share of 75 % is exact: documents that have a passage in
   common, but not enough of it, drop out. Lists that are still long get new
   pivots, the first of which is the member that shares most with others: what
   lies far from most of a group has its links, if any, to such members. After
   ``ROUNDS`` rounds, or one without a new link, each member outside the list's
   main component meets all members of other components whose bits allow a
   link, so no link between components is lost. Bits: each hash sets one of
   ``BITS``; two sets share no more hashes than bits, plus the lesser number of
   hashes whose bit another hash of their set has set.
4. Pairs are filtered by size and by the similarity that the union of their
   sketches estimates; full sets of the rest are compared. The hashes of few
   members, which are counted, are sent to where the pairs are; others are joined
   by shuffles.
5. Components: of a checked number of edges in one task, else by alternating
   large-star and small-star steps.

All joins are keyed, hot keys are aggregated before shuffles or split by AQE.

Defined cases: null or empty texts and texts without a word have an empty set,
are linked with nothing and are kept; fewer than five words give one shingle; a
very long text is one slice, in memory in proportion to its length; repeated
rows are one vertex, as are all rows of a doc_id whose sets no smaller doc_id
has too (those with such a set belong to that one); a null doc_id has no
component and is kept, ``keep_one_of_each`` tells its rows apart by text; an
empty table gives an empty result; only doc_id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import BASE, SPACE, drop_table, mix, shingles, sliced, sweep, texts_only, utf8, words, write_table

K = 64
NEED = 24
ROUNDS = 4
PIVOTS = 4
SHORT = 48
BITS = 2048
#: What pairs of entries are judged by, besides their components.
MEMBER = ("n", "x", "inner", "bits", "excess")
#: Edges that one task joins up: 16 bytes each, and some 100 in memory.
ONE_TASK = 500_000
#: Up to so many pairs, and bytes of their members' hashes, these hashes are sent to the workers that compare the pairs.
FEW_PAIRS, FEW_BYTES = 20_000, 1 << 20
#: A side is broadcast up to this many rows of two longs.
BROADCAST_ROWS = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    hashes, _, _, bounds = words(data, offsets, SPACE)
    every = shingles(hashes, size) if len(hashes) >= size else hashes[:0]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(np.unique(every[a : b - size + 1] if b - a >= size else shingles(hashes[a:b], size)))
    return out


def sketch_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the sketch as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = shingle_sets(*utf8(batch.column(1)))
            with np.errstate(over="ignore"):
                one = np.array([mix(s ^ BASE).sum(dtype=np.uint64) for s in sets], np.uint64)
                two = np.array([mix(s * BASE).sum(dtype=np.uint64) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([s[:K].tobytes() for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "sketch"],
            )

    return texts_only(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sketch binary")


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a written table has few enough rows."""
    return F.broadcast(df) if df.count() <= most else df


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, component of all edges of a task: labels sink along edges and through their own labels until none does."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    ids, place = np.unique(np.concatenate([np.concatenate(side) for side in zip(*held, strict=True)]), return_inverse=True)
    u, v = np.split(place, 2)
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        np.minimum.at(label, before, label.copy())  # what a label's own place has sunk to
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id on an edge (a, b).

    Up to ``ONE_TASK`` edges, which are counted, are joined up by one task; more by alternating large-star and small-star
    steps over all tasks, some six shuffles a step.
    """

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    now = write_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v"), "edges")
    if now.count() <= ONE_TASK:
        return write_table(now.coalesce(1).mapInArrow(_joined_up, "id long, component long"), "neardup-joined")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        old, now = now, write_table(small, "edges")
        drop_table(old)
        before, seen = seen, mark(now)
        if seen == before:
            break
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    return write_table(stars, "neardup-joined")


def _exploded(sets: DataFrame) -> DataFrame:
    """value, id, n of the hashes of each set (id, n, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, 1 << 20):
            data, offsets = utf8(batch.column(2))
            sizes = np.diff(offsets) // 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(data.tobytes(), np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.repeat(batch.column(1).to_numpy(), sizes))], names=["value", "id", "n"]
            )

    return sets.mapInArrow(run, "value long, id long, n long")


def inverted_lists(sets: DataFrame, need) -> DataFrame:
    """value, id, n, x, inner of the values under which each set (id, n, hashes) is listed; linked sets share ``need`` of their
    hashes. x: how many of the hashes another set has too. inner: a link to a set of at least this size, which takes
    6 n / 7 shared hashes, has its first shared hash no later than here."""
    entries = _exploded(sets)
    counts = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rarest = Window.partitionBy("id").orderBy("df", "value")  # no more rows than the set has hashes
    shared = entries.join(counts, "value").withColumns({"at": F.row_number().over(rarest), "x": F.count(F.lit(1)).over(Window.partitionBy("id"))})
    kept = shared.where((F.col("x") >= need) & (F.col("at") <= F.col("x") - need + 1))
    return kept.select("value", "id", "n", "x", (7 * (F.col("x") - F.col("at") + 1) >= 6 * F.col("n")).alias("inner"))


def sketch_need():
    return F.least(F.lit(NEED), F.ceil(F.col("n") * 3 / 4)).cast("int")


def full_need():
    return F.ceil(F.col("n") * 3 / 4).cast("int")


def feasible(lists: DataFrame) -> DataFrame:
    """Without the entries that have too little in common with others for a link even to the list's smallest set: linked
    sets of n and m hashes share 3 (n + m) / 7 at least."""
    smallest = lists.groupBy("value").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return lists.join(smallest, "value").where(7 * F.col("x") >= 3 * (F.col("n") + F.col("least"))).select("value", "id", "n", "x", "inner")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n, hashes: the whole sets of some documents (doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = shingle_sets(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "hashes"])

    return texts_only(docs).withColumn("doc_id", F.col("doc_id").cast("long")).join(ids, "doc_id", "left_semi").mapInArrow(run, "id long, n long, hashes binary")


def with_bits(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """The entries of ``lists`` with the bits of their sets (id, n, hashes) and how many hashes have no bit of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, 1 << 20):
            data, offsets = utf8(batch.column(2))
            hashes, ends = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
            flags = np.zeros((batch.num_rows, BITS), bool)
            flags[np.repeat(np.arange(batch.num_rows), np.diff(ends)), hashes % np.uint64(BITS)] = True
            packed = np.packbits(flags, axis=1, bitorder="little").view(np.int64)
            bits = pa.ListArray.from_arrays(np.arange(0, packed.size + 1, packed.shape[1], dtype=np.int32), packed.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), bits, pa.array(np.diff(ends) - flags.sum(1))], names=["id", "bits", "excess"])

    return lists.drop("bits", "excess").join(sets.mapInArrow(run, "id long, bits array<long>, excess long"), "id")


def bits_allow():
    """Whether two sets (n, bits, excess; n2, ...) may share 3 (n + n2) / 7 hashes, as linked ones do; true without bits."""
    common = sum((F.bit_count(F.get("bits", F.lit(k)).bitwiseAND(F.get("bits2", F.lit(k)))) for k in range(BITS // 64)), F.lit(0))
    return F.col("bits").isNull() | F.col("bits2").isNull() | (7 * (common + F.least("excess", "excess2")) >= 3 * (F.col("n") + F.col("n2")))


def _alike_sketches(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the union of two sketches has enough shared values."""
    union = np.sort(np.concatenate([x, y]))
    twice = union[1:] == union[:-1]
    # the K smallest of the union are known: K distinct values, or all of both
    distinct = np.cumsum(np.concatenate([[1], ~twice]))[1:] <= K
    shared, size = int((twice & distinct).sum()), min(K, len(union) - int(twice.sum()))
    whole = len(x) < K and len(y) < K
    return 100 * shared >= 75 * size if whole else shared * K >= NEED * size


def _alike_sets(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= 75 * (len(both) - shared)


def _sides(pairs: DataFrame) -> DataFrame:
    """doc_id: the members of each pair, as often as they occur."""
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))


def _few(pairs: DataFrame, rows: DataFrame, size) -> bool:
    """Whether the members of some pairs (a written table) may be sent to the workers: ``size`` of their rows (doc_id, ...) sums the bytes."""
    if pairs.count() > FEW_PAIRS:
        return False
    return (rows.join(F.broadcast(_sides(pairs)), "doc_id", "left_semi").agg(F.sum(size)).first()[0] or 0) <= FEW_BYTES


def _passing(pairs: DataFrame, members: DataFrame, alike, few: bool) -> DataFrame:
    """The pairs (a, b) of members (id, hashes) that are ``alike``; few members are sent to where the pairs are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column(2), batch.column(3), strict=True)
            keep = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in found]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (members.select(F.col("id").alias(c), F.col("hashes").alias(f"hashes_{c}")) for c in "ab")
    if few:
        left, right = F.broadcast(left), F.broadcast(right)
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long")


def _estimate(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a written table) whose union sketch has enough shared values."""
    few = _few(pairs, reps.withColumnRenamed("id", "doc_id"), F.length("sketch") + 16)
    members = reps.join(F.broadcast(_sides(pairs)), F.col("id") == F.col("doc_id"), "left_semi") if few else reps
    return _passing(pairs, members.select("id", F.col("sketch").alias("hashes")), _alike_sketches, few)


def _verify(pairs: DataFrame, docs: DataFrame, rows: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a written table) whose full sets are similar enough; a pair may come twice where rows share a doc_id.

    rows: doc_id, n_shingles of all documents. sets: a table that has the sets of all members (id, n, hashes).
    """
    few = _few(pairs, rows, 8 * F.col("n_shingles") + 16)
    ids = _sides(pairs)
    if sets is None:
        sets = full_sets(docs, F.broadcast(ids) if few else _small(write_table(ids.distinct(), "neardup-ids")))
    elif few:
        sets = sets.join(F.broadcast(ids), F.col("id") == F.col("doc_id"), "left_semi")
    return _passing(pairs, sets, _alike_sets, few)


def _lists_now(lists: DataFrame, labels: DataFrame | None, turn: int, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Entries with their components, and the lists of over ``least`` members that are not one component: size, pivots.
    Where entries have bits, the first pivot is one of those that share most hashes with others."""
    if labels is None:
        entries = lists.withColumn("component", F.col("id"))
    else:
        entries = lists.join(_small(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
    most = F.when(F.col("bits").isNotNull(), -F.col("x"))
    pivots = [F.min(F.struct((F.lit(None).cast("long") if i else most).alias("most"), (F.xxhash64("id", F.lit(turn), F.lit(i)) if turn or i else F.col("id")).alias("h"), "id", *MEMBER, "component")) for i in range(PIVOTS)]
    stats = entries.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.array(*pivots).alias("pivots")).where((F.col("lo") < F.col("hi")) & (F.col("size") > least))
    return entries, write_table(stats.select("value", "size", "pivots"), "neardup-open")


def _candidates(entries: DataFrame, stats: DataFrame, pivots: bool, full_upto: int | None) -> DataFrame:
    """Pairs (a, b) of members of one list whose components differ and whose sizes allow a link: with the pivots of lists
    of over ``full_upto`` members, and all pairs of shorter lists (None: of each list, with its main component on one
    side only)."""
    open_ = entries.join(_small(stats, 200_000), "value")
    parts = []
    if pivots:
        long_ = open_.where(F.col("size") > full_upto)
        parts.append(long_.select("id", *MEMBER, "component", F.explode("pivots").alias("p")).select("id", *MEMBER, "component", *[F.col(f"p.{c}").alias(f"{c}2") for c in ("id", *MEMBER, "component")]))
    if full_upto != 0:
        rest = open_ if full_upto is None else open_.where(F.col("size") <= full_upto)
        other = rest.select("value", *[F.col(c).alias(f"{c}2") for c in ("id", *MEMBER, "component")])
        if full_upto is None:
            main = rest.groupBy("value", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("value").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
            other = other.join(main, "value").where("component2 != main").drop("main")
        parts.append(rest.select("value", "id", *MEMBER, "component").join(other, "value").drop("value"))
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    smaller_inner = (F.col("inner") | (F.col("n") > F.col("n2"))) & (F.col("inner2") | (F.col("n2") > F.col("n")))
    return pairs.where((F.col("component") != F.col("component2")) & smaller_inner & (7 * F.least("x", "x2") >= 3 * (F.col("n") + F.col("n2"))) & bits_allow()).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    rows = write_table(sketch_rows(docs), "neardup-sketches")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "h1", "h2"]
    classes = write_table(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members"), "neardup-classes")
    known = _small(classes, 200_000)
    named = rows.select("doc_id", *key).join(known, key, "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    reps = write_table(full.join(known, key, "left").where("rep is null or rep = doc_id").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch"), "neardup-reps")
    lists = write_table(inverted_lists(reps, sketch_need()).withColumns({"x": F.col("n"), "inner": F.lit(True), "bits": F.lit(None).cast("array<long>"), "excess": F.lit(None).cast("long")}), "neardup-lists")
    sweep(docs.sparkSession)
    labels = None

    def settle(pairs: DataFrame, sets: DataFrame | None = None) -> bool:
        """Check pairs and take the links among them into the components; whether there are any."""
        nonlocal labels
        pairs = write_table(pairs, "neardup-pairs")
        likely = write_table(_estimate(pairs, reps), "neardup-likely")
        drop_table(pairs)
        passed = write_table(_verify(likely, docs, rows, sets), "neardup-links")
        drop_table(likely)
        found = bool(passed.limit(1).count())
        if labels is None:
            labels = components(passed)
        elif found:
            labels = components(passed.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        sweep(docs.sparkSession)
        return found

    entries, stats = _lists_now(lists, None, 0)
    settle(_candidates(entries, stats, True, 0))
    entries, stats = _lists_now(lists, labels, 1)
    long_ = stats.where(F.col("size") > SHORT)
    if stats.limit(1).count():
        members = write_table(entries.join(_small(long_.select("value"), 200_000), "value", "left_semi").select(F.col("id").alias("doc_id")).distinct(), "neardup-ids")
        settle(_candidates(entries, stats, False, SHORT))
        if members.limit(1).count():
            sets = write_table(full_sets(docs, _small(members)), "neardup-sets")
            # the sets of a large group lie in few files: their hashes are listed by all tasks evenly
            lists = write_table(with_bits(feasible(inverted_lists(sets.repartition("id"), full_need())), sets), "neardup-lists")
            sweep(docs.sparkSession)
            turn, last = 0, False
            while not last:
                # short lists are compared in full once
                entries, stats = _lists_now(lists, labels, 2 + turn, SHORT if turn else 0)
                if not stats.limit(1).count():
                    break
                found = settle(_candidates(entries, stats, True, 0 if turn else SHORT), sets)
                turn += 1
                last = turn >= ROUNDS or not found
            if last:
                entries, stats = _lists_now(lists, labels, 2 + turn, SHORT)
                if stats.limit(1).count():
                    settle(_candidates(entries, stats, False, None), sets)
            drop_table(sets)
    labels = labels.where("id != component")
    out = named.join(labels, named["rep"] == labels["id"], "left")
    component = F.coalesce("component", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their components, with all their columns.

    Unlike texts that share a doc_id, or have none, are vertices of their own here: the first of a doc_id, by a hash of
    the text, keeps its place in the order, the others and null doc_ids come after all ids below 2^62.
    """
    id_, mark = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    shared = docs.select(id_.alias("__shared"), mark.alias("__mark")).where("__shared is not null").groupBy("__shared").agg(F.min("__mark").alias("__first"), F.max("__mark").alias("__last")).where("__first != __last")
    shared = write_table(shared.drop("__last"), "neardup-shared")
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("__row")
    after = F.pmod(F.xxhash64("__doc", "__mark"), F.lit(1 << 62)) + F.lit(1 << 62)
    own = F.when(F.col("__doc").isNull() | (F.col("__first") != F.col("__mark")), after).otherwise(F.col("__doc"))

    def keyed(*columns) -> DataFrame:
        rows = docs.select(id_.alias("__doc"), mark.alias("__mark"), *columns)
        return rows.join(_small(shared), F.col("__doc") == F.col("__shared"), "left").withColumn("__id", own).drop("__doc", "__mark", "__shared", "__first")

    vertices = keyed(F.col("text").alias("text")).withColumnRenamed("__id", "doc_id")
    gone = write_table(link(vertices).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "neardup-gone")
    return keyed(row).join(_small(gone), F.col("__id") == F.col("__gone"), "left_anti").select("__row.*")
