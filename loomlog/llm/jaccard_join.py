"""Exact set-similarity self-join over word shingles, with set-relation skipping.

Documents link when ``den * intersection >= num * union`` of their sets of distinct shingles.

* Equal sets form one class, of which the least doc_id stands for all.
* Index lists.  Shingles are ordered: those that occur in many documents last (a bounded list of
  the most frequent ones is counted beforehand), all others by hash.  Any order is exact; this one
  keeps lists short.  Linked sets share a shingle among the first n - ceil(t n) + 1 of each.
* The frequent shingles are found by summaries of bounded size (Misra and Gries) of all sets: with N
  shingles altogether, each one outside of the list occurs at most 2 N / MOST_FREQUENT times.  So the
  lists are formed in one shuffle by shingle, in which only the frequent ones are dealt further by document.
* Skipping by position.  A shingle at position i of a set of n leaves n - i; as the first common
  one it admits only partners up to a size that follows from i.  Lists are cut into blocks of
  sizes, and a row meets only blocks inside its interval.
* Answers derived from similar sets.  In long lists all members are first compared with one leader.
  Members that land in one component share its answer; only pairs across components are compared
  afterwards, so a list of n near copies costs n comparisons, not n * n.  Of those pairs, only the ones whose
  bitmaps are alike enough for their sets to link are made: a passage that many texts share makes no pairs.
* Pairs of short lists are counted; those whose count leaves too little room behind their last
  common shingle are dropped before their texts are compared exactly.

The result holds every component exactly: a link is either verified or lies inside a component that
verified links connect.  Sets are compared as sets of 64-bit hashes.

Null doc_ids come last and form one node; rows that share a doc_id form one node, which links
through each of its texts.  (If null, the least and the greatest 64-bit id all occur, the greatest
one counts as null.)  Null and empty texts have no set and link with nothing.  An empty table
gives an empty result; other columns are ignored by ``jaccard_components`` and kept by ``near_dedup``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.bitset import BitSet
from loomlog.llm.cluster import checkpointed, small_batches, stored
from loomlog.llm.components import components
from loomlog.llm.textops import hash_words, mix, prefix_sums, run_hash, slices, sort_within
from loomlog.session import tasks_for

_MOST_COLLIDED = 100_000  # hashes; 10**12 rows have about 27,000 pairs of one hash
_NO_ID = (1 << 63) - 1
SHINGLE, NUM, DEN = 5, 75, 100
MOST_FREQUENT = 1 << 16
LONG = 32
_SHARE = 2048
_PENDING = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and their bounds."""
    words, _, _, bounds = hash_words(data, offsets, lower=True)
    acc = prefix_sums(words)
    size = np.diff(bounds)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][doc]
    h = run_hash(acc, start, start + np.minimum(k, size)[doc])
    order = sort_within(doc, h)
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(size) + 1))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class _Summary:
    """Counts of the most frequent of many hashes: with N seen, each is too low by N / size at most."""

    def __init__(self, size: int):
        self.size, self.pending, self.waiting = size, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, h: np.ndarray) -> None:
        self.pending.append(h)
        self.waiting += len(h)
        if self.waiting > _PENDING:
            self.settle()

    def settle(self) -> None:
        keys, counts = np.unique(np.concatenate([*self.pending, np.zeros(0, np.uint64)]), return_counts=True)
        self.pending, self.waiting = [], 0
        keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, counts]), len(keys)).astype(np.int64)
        if len(keys) > self.size:
            counts -= np.partition(counts, len(counts) - self.size - 1)[len(counts) - self.size - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def _survey(k: int, most: int):
    """Per text its set's size and 128-bit sum; per task a summary of its frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "n", "one", "two"]
        summary = _Summary(most)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                h, cut = shingle_sets(data, offsets, k)
                one = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(11)), dtype=np.uint64)])
                two = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
                summary.add(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(hi - lo, np.int32)), batch.column(0).slice(lo, hi - lo), pa.array(np.diff(cut)), _long(one[cut[1:]] - one[cut[:-1]]), _long(two[cut[1:]] - two[cut[:-1]])],
                    names=names,
                )
        summary.settle()
        h, n = summary.keys[summary.counts > 1], summary.counts[summary.counts > 1]
        none = pa.array(np.zeros(len(h), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), _long(h), pa.array(n), none, none], names=names)

    return run


def _prefixes(k: int, num: int, den: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = frequent.value  # sorted hashes; their places in the order
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, data, offsets in slices(batch.column(1)):
                h, cut = shingle_sets(data, offsets, k)
                if not len(h):
                    continue
                n = np.diff(cut)
                doc = np.repeat(np.arange(hi - lo), n)
                place = np.zeros(len(h), dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    place = np.where(common[at] == h, rank[at] + 1, 0)
                order = np.lexsort((place, doc))  # stable: hashes stay sorted among equal places
                position = np.arange(len(h)) - cut[doc]
                take = position < (n - -(-n * num // den) + 1)[doc]
                doc = doc[take]
                yield pa.RecordBatch.from_arrays(
                    [_long(h[order][take]), pa.array(place[order][take] > 0), pa.array(ids[lo:hi][doc]), pa.array(n[doc].astype(np.int32)), pa.array(position[take].astype(np.int32))],
                    names=["token", "often", "id", "n", "at"],
                )

    return run


def parities(h: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """Per set one bit or more for each member: whether an odd number of its hashes fall on each place of a bitmap.

    Bitmaps of two sets differ in no more places than the sets have members that they do not share.  A bitmap has the
    least power of 2 of words that gives each member a bit; one of twice as many words folds to it by xor of its halves.
    """
    n = np.diff(cut)
    words = 1 << np.ceil(np.log2(np.maximum(1, -(-n // 64)))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(words)])
    place = mix(h + np.uint64(29)) & np.repeat(words * 64 - 1, n).astype(np.uint64)
    out = np.zeros(begin[-1], dtype=np.uint64)
    np.bitwise_xor.at(out, np.repeat(begin[:-1], n) + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return [out[a:b].view(np.int64) for a, b in zip(begin[:-1], begin[1:])]


def _bitmaps(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                bits = parities(*shingle_sets(data, offsets, k))
                ends = np.cumsum([0, *map(len, bits)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bits)))], names=["id", "bits"])

    return run


def differing(a: Column, b: Column) -> Column:
    """In how many places two bitmaps differ, the longer one folded; 0 if a bitmap is null or they do not fit."""
    folded = lambda x, y: F.when(F.size(x) == 2 * F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda u, v: u.bitwiseXOR(v))).otherwise(x)
    differ = F.zip_with(folded(a, b), folded(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.coalesce(F.aggregate(differ, F.lit(0), lambda n, x: n + x), F.lit(0))


def _overlaps(k: int):
    """Sizes and intersection of the sets of two texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = batch.column(2), batch.column(3)
            for lo in range(0, len(first), 512):
                sizes, keys = [], []
                ids = batch.column(0).slice(lo, 512)
                texts = first.slice(lo, 512)
                # Rows come in the order of a, and mostly repeat its text.
                new = np.concatenate([[True], pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)])
                for column, which in ((first, np.cumsum(new) - 1), (second, np.arange(len(ids)))):
                    texts = column.slice(lo, 512)
                    if column is first:
                        texts = texts.filter(pa.array(new))
                    sets = []
                    for _, _, data, offsets in slices(texts):
                        h, cut = shingle_sets(data, offsets, k)
                        sets += [h[cut[i] : cut[i + 1]] for i in range(len(cut) - 1)]
                    n = np.array([len(x) for x in sets], dtype=np.int64)[which]
                    keys.append((np.repeat(np.arange(len(ids)), n), np.concatenate([sets[i] for i in which])))
                    sizes.append(n)
                row, h = (np.concatenate(x) for x in zip(*keys))
                order = sort_within(row, h)
                row, h = row[order], h[order]
                twice = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
                common = np.bincount(row[1:][twice], minlength=len(sizes[0]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, 512), batch.column(1).slice(lo, 512), pa.array(sizes[0].astype(np.int64)), pa.array(sizes[1].astype(np.int64)), pa.array(common.astype(np.int64))],
                    names=["a", "b", "n_a", "n_b", "common"],
                )

    return run


class _Join:
    def __init__(self, docs: DataFrame, k: int, num: int, den: int, long: int):
        self.spark, self.k, self.num, self.den, self.long = docs.sparkSession, k, num, den, long
        small_batches(self.spark)
        doc_id = F.col("doc_id").cast("long")
        ends = docs.agg(F.min(doc_id), F.max(doc_id), F.count_if(doc_id.isNull()), F.count("*")).first()
        self.tasks = tasks_for(ends[3])  # for tables of one short row per document at most
        # The stand-in for null is the greatest number; if that is an id, all ids move down by one.
        self.nulls = ends[2] > 0
        self.shift = int(self.nulls and ends[1] == _NO_ID and ends[0] > -_NO_ID - 1)
        self.docs = docs.select(F.coalesce(doc_id - self.shift, F.lit(_NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def shown(self, column: str) -> Column:
        """A node as the doc_id that it stands for."""
        doc_id = F.col(column) + self.shift if self.shift else F.col(column)
        return F.when(F.col(column) != _NO_ID, doc_id) if self.nulls else doc_id

    def needs(self, rest: Column, n_a: Column, n_b: Column) -> Column:
        """Whether an intersection of ``rest`` suffices for sets of these sizes."""
        return (self.num + self.den) * rest.cast("long") >= self.num * (n_a.cast("long") + n_b)

    def survey(self) -> tuple[DataFrame, DataFrame]:
        """id, n, class_id of every row; token, n of the most frequent shingles."""
        seen = checkpointed(self.docs.mapInArrow(_survey(self.k, MOST_FREQUENT), "kind int, key long, n long, one long, two long"))
        sets = seen.filter("kind = 0").select(F.col("key").alias("id"), "n", "one", "two")
        # Stored before the join, so that Spark can split a class that holds many of the rows.
        least = checkpointed(sets.filter("n > 0").groupBy("n", "one", "two").agg(F.min("id").alias("class_id"), F.count("*").alias("c")).filter("c > 1").drop("c"), self.tasks)
        classes = checkpointed(sets.join(least, ["n", "one", "two"], "left").select("id", "n", F.coalesce("class_id", "id").alias("class_id")), self.tasks)
        often = seen.filter("kind = 1").groupBy(F.col("key").alias("token")).agg(F.sum("n").alias("n"))
        return classes, often.filter(F.col("n") >= 2 * self.long).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT)

    def lists(self, copies: DataFrame, often: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Index lists of at least two rows, but for those of ``copies``, which other ids stand for.

        Short lists: token, members (id, n, at).  Long ones: token, listed, id, n, at.
        """
        token = often.select("token").toArrow()["token"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(token)
        places = np.arange(len(token), 0, -1, dtype=np.int64)
        frequent = self.spark.sparkContext.broadcast((token[order], places[order]))  # at most MOST_FREQUENT entries
        known = BitSet(copies, "id")
        firsts = known.part(self.docs, F.col("id"), False).unionByName(known.part(self.docs, F.col("id"), True).join(copies, "id", "left_anti"))
        rows = firsts.mapInArrow(_prefixes(self.k, self.num, self.den, frequent), "token long, often boolean, id long, n int, at int")
        # The rows of a frequent shingle are dealt further by id; the others meet in one task, and so few that it can be.
        share = F.when(F.col("often"), F.pmod(F.xxhash64("id"), F.lit(1 << 16)).cast("int")).otherwise(0)
        counted = rows.withColumn("share", share).withColumn("c", F.count("*").over(Window.partitionBy("token", "share"))).filter("often OR c > 1")
        part = F.when(F.col("often"), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / _SHARE)))  # no row holds more than about _SHARE members
        grouped = counted.withColumn("part", part).groupBy("token", "share", "part", "often").agg(F.max("c").alias("c"), F.collect_list(F.struct("id", "n", "at")).alias("members"))
        found = stored(grouped.select("token", "often", "c", "members"), "lists")
        of_often = found.filter("often").groupBy(F.col("token").alias("t")).agg(F.sum(F.size("members")).alias("total"))
        listed = F.coalesce("total", "c")
        found = found.join(F.broadcast(of_often), F.col("often") & (F.col("token") == F.col("t")), "left").select("token", "often", listed.alias("listed"), "members")
        long = found.filter((F.col("listed") > self.long) | F.col("often") & (F.col("listed") > 1)).select("token", "listed", F.inline("members"))
        return found.filter(~F.col("often") & (F.col("listed") <= self.long)).select("token", "members"), long

    def by_list(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """Rows of long lists with the table's row (t, size) for their list; a list is dealt over tasks by its length."""
        shares = lambda c: F.ceil(F.col(c) / _SHARE).cast("int")
        rows = rows.withColumn("share", F.pmod(F.xxhash64("id"), shares("listed")).cast("int"))
        table = table.withColumn("of_share", F.explode(F.sequence(F.lit(0), shares("size") - 1)))
        return rows.join(table, (F.col("token") == F.col("t")) & (F.col("share") == F.col("of_share"))).drop("share", "of_share", "t", "size")

    def fits(self) -> Column:
        """Whether a shared shingle could be the first common one of a linked pair a, b."""
        a, b = F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")
        return self.needs(a, F.col("n_a"), F.col("n_b")) & self.needs(b, F.col("n_a"), F.col("n_b"))

    def short_pairs(self, short: DataFrame, long: DataFrame, several: DataFrame | None) -> DataFrame:
        """Pairs that share a shingle of a short list and may still reach the threshold."""
        side = lambda x: [F.col(f"{x}_.{c}").alias(n) for c, n in (("id", x), ("n", f"n_{x}"), ("at", f"at_{x}"))]
        alike = (F.col("a") < F.col("b")) & (self.den * F.col("n_a") >= self.num * F.col("n_b")) & (self.den * F.col("n_b") >= self.num * F.col("n_a"))
        met = short.select(F.explode("members").alias("a_"), "members").select("a_", F.explode("members").alias("b_")).select(*side("a"), *side("b")).filter(alike)
        last = [F.max(c).alias(c) for c in ("n_a", "n_b", "at_a", "at_b")]
        pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"), *last, F.max(self.fits()).alias("fits"))
        more = long.groupBy("id").agg(F.count("*").alias("more"))
        more_a, more_b = more.select(F.col("id").alias("a"), F.col("more").alias("more_a")), more.select(F.col("id").alias("b"), F.col("more").alias("more_b"))
        room = F.col("shared") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0))) + self.behind()
        may = self.needs(room, F.col("n_a"), F.col("n_b")) & (F.col("fits") | (F.coalesce("more_a", F.lit(0)) > 0) & (F.coalesce("more_b", F.lit(0)) > 0))
        pairs = pairs.join(more_a, "a", "left").join(more_b, "b", "left")
        return self.or_several(pairs, may, several).select("a", "b")

    @staticmethod
    def or_several(pairs: DataFrame, may: Column, several: DataFrame | None) -> DataFrame:
        """Pairs that may link: bounds hold for single texts, so ids with several texts stay in any case."""
        if several is None:
            return pairs.filter(may)
        for x in ("a", "b"):
            pairs = pairs.join(several.select(F.col("id").alias(x), F.lit(True).alias(f"several_{x}")), x, "left")
        return pairs.filter(F.coalesce("several_a", "several_b", F.lit(False)) | may)

    def behind(self) -> Column:
        """How many shingles two sets can share beside those common to both prefixes.

        All of them lie behind the last common one, at at_a and at_b; and they lie outside of the
        prefix that ends first in the order, which may be that of either set.
        """
        outside = lambda n: F.ceil(n * self.num / self.den) - 1
        last = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1
        return F.least(last, outside(F.greatest("n_a", "n_b")))

    def leader_pairs(self, long: DataFrame) -> DataFrame:
        """Members of long lists with their list's leader: the one with the fewest rarer shingles."""
        leaders = long.groupBy("token").agg(F.min(F.struct("at", F.xxhash64("id").alias("h"), "id", "n")).alias("l"), F.max("listed").alias("size"))
        leaders = leaders.select(F.col("token").alias("t"), "size", F.col("l.id").alias("a"), F.col("l.n").alias("n_a"), F.col("l.at").alias("at_a"))
        pairs = self.by_list(long, leaders).withColumnsRenamed({"id": "b", "n": "n_b", "at": "at_b"})
        return pairs.filter((F.col("a") != F.col("b")) & self.fits()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def bitmaps(self, ids: DataFrame) -> DataFrame:
        """id, bits of at least these ids; null for an id that has several texts."""
        found = BitSet(ids, "id").part(self.docs, F.col("id"), True).mapInArrow(_bitmaps(self.k), "id long, bits array<long>")
        return found.groupBy("id").agg(F.min("bits").alias("bits"), F.max("bits").alias("most")).select("id", F.when(F.col("bits") == F.col("most"), F.col("bits")).alias("bits"))

    def met(self, mixed: DataFrame) -> DataFrame:
        """Pairs of rows (token, id, n, at, label, major) of a list that have different labels and may link by place, size and bitmap."""
        block = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(self.den / self.num)) * 2).cast("int")
        mixed = checkpointed(mixed)
        mixed = checkpointed(mixed.join(self.bitmaps(mixed.select("id").distinct()), "id", "left"))
        # The sizes of partners that position ``at`` admits.
        upper = F.floor((F.col("n") - F.col("at")) * (self.num + self.den) / self.num + 1e-9) - F.col("n")
        lower = F.ceil(F.col("n") * self.num / self.den - 1e-9)
        minor = mixed.filter("label <> major AND n > 0").withColumn("lo", lower).withColumn("hi", upper).filter("lo <= hi AND hi > 0")
        probes = minor.select("token", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("label").alias("label_a"), F.col("bits").alias("bits_a"), F.explode(F.sequence(block(F.greatest("lo", F.lit(1))), block(F.col("hi")))).alias("block"))
        index = mixed.select("token", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("label").alias("label_b"), F.col("bits").alias("bits_b"), block(F.col("n")).alias("block"))
        # Sets whose bitmaps differ in d places share at most (n_a + n_b - d) / 2.
        alike = self.needs(F.floor((F.col("n_a").cast("long") + F.col("n_b") - differing(F.col("bits_a"), F.col("bits_b"))) / 2), F.col("n_a"), F.col("n_b"))
        return probes.join(index, ["token", "block"]).filter((F.col("label_a") != F.col("label_b")) & self.fits() & alike)

    def open_pairs(self, short: DataFrame, long: DataFrame, known: DataFrame, several: DataFrame | None) -> DataFrame:
        """Pairs of long lists that lie in different components so far."""
        rows = long.join(known, F.col("id") == F.col("node"), "left")
        rows = checkpointed(rows.select("token", "listed", "id", "n", "at", F.coalesce("component", "id").alias("label")))
        sizes = rows.groupBy("token", "label").agg(F.count("*").alias("c"), F.max("listed").alias("size"))
        major = sizes.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels"), F.max("size").alias("size")).filter("labels > 1").select(F.col("token").alias("t"), "size", F.col("m.label").alias("major"))
        pairs = self.met(self.by_list(rows, major))
        swapped = F.col("a") > F.col("b")
        pairs = pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(
            F.max(F.when(swapped, F.col("at_b")).otherwise(F.col("at_a"))).alias("at_a"), F.max(F.when(swapped, F.col("at_a")).otherwise(F.col("at_b"))).alias("at_b")
        ).withColumnsRenamed({"low": "a", "high": "b"})
        pairs = checkpointed(pairs)
        # All common shingles of two prefixes are listed, so their number bounds the intersection.
        named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        every = long.select("token", "id", "n").unionByName(short.select("token", F.inline("members")).select("token", "id", "n"))
        # A bitmap keeps most other rows out; that of a row too many does no harm, as the pairs are joined by id.
        of = BitSet(named, "id").part(every, F.col("id"), True).groupBy("id").agg(F.collect_set("token").alias("t"), F.max("n").alias("n"))
        end = lambda x: of.select(F.col("id").alias(x), F.col("t").alias(f"t_{x}"), F.col("n").alias(f"n_{x}"))
        both = pairs.join(end("a"), "a").join(end("b"), "b")
        room = F.size(F.array_intersect("t_a", "t_b")) + self.behind()
        return self.or_several(both, self.needs(room, F.col("n_a"), F.col("n_b")), several).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """a, b, n_a, n_b, common of the pairs that link, from their whole texts."""
        texts = BitSet(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id").part(self.docs, F.col("id"), True)
        with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
        checked = both.mapInArrow(_overlaps(self.k), "a long, b long, n_a long, n_b long, common long")
        return checkpointed(checked.filter(self.needs(F.col("common"), F.col("n_a"), F.col("n_b")) & (F.col("common") > 0)))


def jaccard_components(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN, long: int = LONG) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class_id, component_id."""
    if not 0 < num <= den:
        raise ValueError("the threshold num/den must lie above 0 and at most at 1")
    join = _Join(docs, k, num, den, long)
    rows, often = join.survey()
    of_id = checkpointed(rows.filter("n > 0").groupBy("id").agg(F.max(F.col("id") == F.col("class_id")).alias("first"), (F.min("class_id") != F.max("class_id")).alias("several")), join.tasks)
    several = of_id.filter("several").select("id")
    several = None if several.isEmpty() else several
    short, long_ = join.lists(of_id.filter("NOT first").select("id"), often)
    pairs = stored(join.short_pairs(short, long_, several).unionByName(join.leader_pairs(long_)).distinct(), "pairs")
    links = join.verified(pairs).select(F.col("a").alias("u"), F.col("b").alias("v"))
    if several is not None:  # a doc_id that stands for several texts ties their classes together
        links = links.unionByName(rows.join(several, "id").select(F.col("id").alias("u"), F.col("class_id").alias("v")))
    known = components(links)
    rest = checkpointed(join.open_pairs(short, long_, known, several))
    if not rest.isEmpty():
        more = join.verified(rest)
        known = components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    out = rows.join(known, F.col("class_id") == F.col("node"), "left").select("id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return out.select(join.shown("id").alias("doc_id"), "n_shingles", join.shown("class_id").alias("class_id"), join.shown("component_id").alias("component_id"))


def hashes(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes of 64 bits of a row."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.reverse(text), F.lit(7919), doc_id)


def near_dedup(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs`` of which each component keeps one; rows without a set stay.

    Decided row by row: a node is a pair of doc_id and text, known by its 64-bit hash, so rows with
    null or repeated ids are compared by their own texts only.  A second hash of 64 bits tells pairs apart whose
    first hashes collide; they are known by the second one.  The least doc_id of a component stays
    (null last), of several texts that have it one, and of equal rows one.
    """
    node, check = (F.least(x, F.lit(_NO_ID - 1)) for x in hashes(F.col("doc_id"), F.col("text")))
    tasks = tasks_for(docs.count())
    ids = checkpointed(docs.groupBy(node.alias("node")).agg(F.min("doc_id").alias("id"), F.min(check).alias("low"), F.max(check).alias("high")), tasks)
    collided = ids.filter("low <> high").select(F.col("node").alias("of"))
    if not collided.isEmpty():  # about 3 of 10**10 documents
        twice = checkpointed(collided)
        node = F.when(node.isin([r[0] for r in twice.limit(_MOST_COLLIDED).collect()]), check).otherwise(node)
        ids = docs.groupBy(node.alias("node")).agg(F.min("doc_id").alias("id"))
    ids = ids.select("node", "id")
    found = jaccard_components(docs.select(node.alias("doc_id"), "text"), k, num, den).filter("n_shingles > 0")
    nodes = found.groupBy(F.col("doc_id").alias("node")).agg(F.min("component_id").alias("component"), F.count("*").alias("copies"))
    nodes = checkpointed(nodes.join(ids, "node"), tasks)
    # Joined by node and not by component: the members of a large component are dealt over many tasks.
    first = nodes.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("f")).select(F.col("f.node").alias("node"))
    gone = checkpointed(nodes.join(first, "node", "left_anti").select("node"), tasks)
    repeated = nodes.filter("copies > 1").select("node")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), node.alias("node"))
    # Rows whose node surely neither goes nor repeats pass without a shuffle.
    touched = BitSet(gone.unionByName(repeated), "node")
    passed, maybe = (touched.part(rows, F.col("node"), x) for x in (False, True))
    kept = maybe.join(gone, "node", "left_anti")
    if repeated.isEmpty():
        return passed.unionByName(kept).select("row.*")
    once = kept.join(repeated, "node", "left_semi").groupBy("node").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return passed.unionByName(kept.join(repeated, "node", "left_anti")).select("row.*").unionByName(once.select("row.*"))
