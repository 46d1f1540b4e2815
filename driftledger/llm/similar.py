"""Near-duplicates by shingle similarity, around the ball hashing of simhash.py.

Fingerprints of shingles find copies that differ in few bits; each such link is checked on the whole shingle sets. A
pair of Jaccard similarity 0.8 differs in about ten of 64 bits, and no ball of that radius can be sent out, so that the
rest is found by rare shingles: of two sets of similarity t or more, the n - ceil(t n) + k first members in any common
order have k in common, for every k up to ceil(t n). The order begins with shingles that a sample has not met often, so
that passages in many documents join few of them; the sample decides what is fast, not what is found.

Most pairs that meet at a shingle are not of the similarity. Before whole sets are dealt out, two short sketches are
compared, whose bits bound from below in how many members the sets differ: no pair of the similarity fails that test.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import keep_one, links, majority, shingle_hashes, text_key
from .storage import bounded_batches, drop_staged, shuffles_removed, staged

SAMPLE, OFTEN, SHARED = 8000, 8, 8
#: Shingles that more sets hold are tried by rounds of hubs first, which end when one adds no more than this part of all
#: links; pairs that these leave apart are then looked at.
FEW, MORE = 64, 0.05
#: How many sets of a widely held shingle go to a task together, when its remaining pairs are made.
BLOCK = 2048
#: Longs of a sketch, and the shingles of a set that go along to tell whether two sets have met at another shingle.
SKETCH, FIRST = 16, 8
#: How many members of sets a check of pairs may deal out at once, at least; more where the corpus has more (_Search.room).
LEAST_ROOM = 32 << 20
#: Bytes of pairs or labels that may be broadcast, as counted.
BROADCAST = 8 << 20


def shingles(text: str | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of all shingles, rising; fewer words than a shingle are one, no words none."""
    return np.unique(shingle_hashes(text, size, seed).view(np.int64))


def sketch(members: np.ndarray) -> np.ndarray:
    """SKETCH longs, each bit set if an odd number of members falls on it: sets differ in at least as many members as bits."""
    bits = 64 * SKETCH
    at = (members.view(np.uint64) >> np.uint64(32)) % np.uint64(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))


def _rows(size: int, often: np.ndarray | None, percent: int, sketches: bool = False):
    """Rows of SCHEMA with all members, or with a list of frequent ones the first in the order; sketches where asked for."""
    import xxhash

    by_hash = None if often is None else np.argsort(often)
    in_order = None if often is None else often[by_hash]

    def first(s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s
        same = -(-percent * len(s) // 100)
        take = len(s) - same + min(SHARED, same)
        place = np.full(len(s), -1)
        if len(often):
            at = np.minimum(np.searchsorted(in_order, s), len(often) - 1)
            place = np.where(in_order[at] == s, by_hash[at], -1)
        return s[np.argsort(place, kind="stable")[:take]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                every = [shingle_hashes(t, size) for t in part.column(2).to_pylist()]
                fp = np.array([0 if often is None else majority(x) for x in every], np.uint64).view(np.int64)
                sets = [np.unique(x.view(np.int64)) for x in every]
                ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
                members = sets if often is None else list(map(first, sets))
                columns = [part.column(0), part.column(1), pa.array(ids), pa.array(np.array(list(map(len, sets)), np.int64)), pa.array(fp), _lists(members), _lists(list(map(sketch, sets)) if sketches else [sets[0][:0]] * len(sets))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "set_id", "n", "fp", "members", "sketch"])

    return run


SCHEMA = "doc_id long, text_key long, set_id long, n long, fp long, members array<long>, sketch array<long>"


def _frequent(texts: DataFrame, size: int) -> np.ndarray:
    """Shingles that a sample of distinct texts holds often, the rarest first."""
    part = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod("text_key", F.lit(part)) == 0).dropDuplicates(["text_key"]).mapInArrow(_rows(size, None, 0), SCHEMA)
    counts = sample.select(F.explode("members").alias("h")).groupBy("h").count().where(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.col("count").desc(), "h").limit(200_000).collect()
    return np.array([r.h for r in reversed(rows)], np.int64)


class _Search:
    """The distinct sets of a corpus that may have a partner, and the links found among them so far."""

    def __init__(self, texts: DataFrame, size: int, percent: int):
        self.percent = percent
        rows = staged(texts.mapInArrow(_rows(size, _frequent(texts, size), percent), SCHEMA), "shingles")
        self.rows = staged(rows.drop("members", "sketch"), "rows")
        # What is dealt out at once, in members: half of those of the corpus, so that disk is in proportion to it.
        self.room = max(LEAST_ROOM, (self.rows.agg(F.sum("n")).first()[0] or 0) // 2)
        keys = self.rows.groupBy("set_id").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("fp").alias("fp"))
        # Only shingles of several sets count; copies of a set are no others, and fold while they are counted.
        each = rows.select(F.explode("members").alias("h"), "set_id")
        several = each.groupBy("h").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most")).where("least <> most").select("h")
        met = staged(each.join(several, "h").distinct(), "met")
        drop_staged(rows)
        enough = met.groupBy("set_id").agg(F.count(F.lit(1)).alias("met")).join(keys, "set_id").where(F.col("met") >= self.least(F.col("n")))
        self.sets = staged(enough.drop("met"), "possible")
        self.met = staged(met.join(self.sets.select("set_id", "n"), "set_id"), "met-possible")
        # One text of each possible set: texts are dealt out once, copies folded first.
        one = texts.groupBy("text_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).join(self.sets.select("text_key"), "text_key", "left_semi")
        self.whole = staged(one.select("doc_id", "text_key", "text").mapInArrow(_rows(size, None, 0, True), SCHEMA).select("set_id", "n", "members", "sketch"), "sets")
        drop_staged(met)
        self.found: list[DataFrame] = []
        self.n_links = 0

    def least(self, n: Column) -> Column:
        """Members that the first ones of two sets share, if the smaller of them has n in all."""
        return F.least(F.lit(SHARED), F.ceil(n * self.percent / 100))

    def alike(self, a: str, b: str) -> Column:
        return (F.col(a) * 100 >= F.col(b) * self.percent) & (F.col(b) * 100 >= F.col(a) * self.percent)

    def may_link(self, a: str, b: str, n_a: str, n_b: str) -> Column:
        """Whether sets of these sketches can be of the similarity; (100 - percent) / (100 + percent) of their members may differ."""
        differ = functools.reduce(Column.__add__, (F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH)))
        return differ * (100 + self.percent) <= (F.col(n_a) + F.col(n_b)) * (100 - self.percent)

    def both(self, pairs: DataFrame, few: bool, column: str) -> DataFrame:
        """The pairs with n and a column of both sets. Few pairs go to the sets, so that only sets of pairs are dealt out, and once."""
        if few:
            sides = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("set_id"))
            met = self.whole.select("set_id", "n", column).join(F.broadcast(sides), "set_id")
            of = lambda side, c: F.first(F.when(F.col("set_id") == F.col(side), F.col(c)), ignorenulls=True)
            return met.groupBy("u", "v").agg(*(of(x, c).alias(f"{c[0]}_{x}") for x in "uv" for c in ("n", column)))
        u, v = (self.whole.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"{column[0]}_{x}")) for x in "uv")
        return pairs.join(u, "u").join(v, "v")

    def check(self, pairs: DataFrame, sketched: bool = False) -> int:
        """Keep those of the pairs (u, v, members: of both) of set_ids whose whole sets reach the similarity; how many these are.

        Sketches are compared first, unless they were. Sets of the pairs left are dealt out in parts that fit the room, so
        that many pairs take more rounds and no more disk.
        """
        pairs = staged(pairs.groupBy("u", "v").agg(F.first("members").alias("members")), "pairs")
        if not sketched:
            every = pairs
            near = self.both(every, every.count() * 32 <= BROADCAST, "sketch").where(self.may_link("s_u", "s_v", "n_u", "n_v"))
            pairs = staged(near.select("u", "v", (F.col("n_u") + F.col("n_v")).alias("members")), "near")
            drop_staged(every)
        n_pairs, members = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("members"), F.lit(0))).first()
        parts, n = max(1, -(-members // self.room)), 0
        for k in range(parts):
            part = pairs.select("u", "v").where(F.pmod(F.xxhash64("u", "v"), F.lit(parts)) == k)
            both = self.both(part, n_pairs * 32 <= parts * BROADCAST, "members").withColumn("c", F.size(F.array_intersect("m_u", "m_v")))
            found = staged(both.where((100 + self.percent) * F.col("c") >= self.percent * (F.col("n_u") + F.col("n_v"))).select("u", "v"), "links")
            self.found.append(found)
            n += found.count()
        drop_staged(pairs)
        self.n_links += n
        return n

    def components(self) -> DataFrame:
        """(set_id, label) of the sets that have links."""
        links = functools.reduce(DataFrame.unionByName, self.found)
        return connected_components(links).select(F.col("node").alias("set_id"), "label")

    def labelled(self, met: DataFrame) -> DataFrame:
        """The rare shingles of sets with their present component; labels are broadcast where they are counted to be few."""
        label = self.components()
        if 2 * self.n_links * 16 <= BROADCAST:  # a link labels two sets at most
            label = F.broadcast(label)
        return met.join(label, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))

    def by_fingerprint(self) -> None:
        """Sets of one fingerprint, and of fingerprints that meet in a ball, with the smallest of them; a set that can have no partner is left out."""
        of = self.sets.groupBy("fp").agg(F.min(F.struct("set_id", "n")).alias("least")).select("fp", "least.*")
        same = self.sets.join(of.toDF("fp", "v", "n_v"), "fp").where("set_id <> v").select(F.col("set_id").alias("u"), "v", (F.col("n") + F.col("n_v")).alias("members"))
        near = links(of.select("fp"), 2).toDF("fp_u", "fp_v").join(of.toDF("fp_u", "u", "n_u"), "fp_u").join(of.toDF("fp_v", "v", "n_v"), "fp_v")
        self.check(same.unionByName(near.select("u", "v", (F.col("n_u") + F.col("n_v")).alias("members"))))

    def by_hub(self, wide: DataFrame, k: int) -> int:
        """For each widely held shingle, its sets with one of them, chosen anew each round, unless they are in one component.

        Every other round that is one of the sets with the most such shingles: of a group of near copies those least edited.
        """
        held = F.count(F.lit(1)).over(Window.partitionBy("set_id")) if k % 2 == 0 else F.lit(0)
        now = staged(self.labelled(wide).withColumn("rank", F.struct((-held).alias("held"), F.xxhash64("set_id", F.lit(k)).alias("hash"))), "labelled")
        hub = now.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("rank", "set_id", "n", "label")).alias("hub")).where("lo <> hi")
        hub = hub.select("h", F.col("hub.set_id").alias("v"), F.col("hub.n").alias("n_v"), F.col("hub.label").alias("label_v"))
        pairs = now.join(hub, "h").where((F.col("label") != F.col("label_v")) & self.alike("n", "n_v"))
        pairs = pairs.groupBy(F.col("set_id").alias("u"), "v").agg(F.count(F.lit(1)).alias("shared"), F.first(F.col("n") + F.col("n_v")).alias("members"), F.min(F.least("n", "n_v")).alias("n"))
        found = self.check(pairs.where(F.col("shared") >= self.least(F.col("n"))))
        drop_staged(now)
        return found

    def parts(self, now: DataFrame, met: DataFrame) -> Iterator[DataFrame]:
        """The rows by parts of the sets, so that of ``met``, a row with the number of times that two sets meet, a part fits the room."""
        parts = max(1, -(-4 * int(met.first()[0] or 0) // self.room))  # a meeting takes about four members' bytes
        for k in range(parts):
            yield now.where(F.pmod(F.xxhash64("set_id", F.lit(parts)), F.lit(parts)) == k)

    def by_pairs(self, narrow: DataFrame, held: DataFrame) -> None:
        """All pairs of different components that share a shingle which few sets hold; ``held``: widely held ones of a set."""
        now = staged(self.labelled(narrow.join(held, "set_id", "left").withColumn("wide", F.coalesce("wide", F.lit(0)))), "apart")
        other = now.select("h", F.col("set_id").alias("v"), F.col("n").alias("n_v"), F.col("label").alias("label_v"), F.col("wide").alias("wide_v"))
        for part in self.parts(now, now.groupBy("h").agg(F.count(F.lit(1)).alias("sets")).agg(F.sum(F.col("sets") * (F.col("sets") - 1) / 2))):
            pairs = part.join(other, "h").where((F.col("label") < F.col("label_v")) & self.alike("n", "n_v"))
            # What a pair shares among the widely held ones is not counted; it is at most what either has of these.
            pairs = pairs.groupBy(F.col("set_id").alias("u"), "v").agg(F.count(F.lit(1)).alias("shared"), F.first(F.col("n") + F.col("n_v")).alias("members"), F.min(F.least("n", "n_v")).alias("n"), F.min(F.least("wide", "wide_v")).alias("wide"))
            self.check(pairs.where(F.col("shared") + F.col("wide") >= self.least(F.col("n"))))
        drop_staged(now)

    def by_rest(self, wide: DataFrame) -> None:
        """All pairs still apart that share widely held shingles only: with by_pairs, no pair of the similarity is left out.

        Such a pair shares as many as least() says of either's n. In one order of shingles, the widest held first, either
        can leave out one less than that from the front and still shares one with the other; so the widest held meet least.
        For each shingle left, the sets outside its largest component meet all others, in blocks, so that a task has
        BLOCK squared meetings of a shingle at most, however many hold it. Sketches are compared where sets meet, and a
        pair leaves its first meeting only, as far as the FIRST shingles of both tell, so that what is made follows the
        pairs that are nearly of the similarity; comparisons in memory still grow with the square of such a group.
        """
        rank = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("sets"), "h"))
        few = staged(wide.withColumn("rank", rank).where(F.col("rank") >= self.least(F.col("n"))).select("h", "set_id", "n"), "rest")
        now = staged(self.labelled(few), "apart")
        order = F.row_number().over(Window.partitionBy("set_id").orderBy("h"))
        first = few.withColumn("order", order).where(F.col("order") <= FIRST).groupBy("set_id").agg(F.collect_list("h").alias("first"))
        known = staged(self.whole.select("set_id", "sketch").join(first, "set_id"), "sketches")
        drop_staged(few)
        each = now.groupBy("h", "label").agg(F.count(F.lit(1)).alias("sets"))
        spread = each.groupBy("h").agg(F.sum("sets").alias("all"), F.max(F.struct("sets", "label")).alias("most")).where(F.col("all") > F.col("most.sets"))
        spread = spread.select("h", F.col("most.label").alias("most"), F.col("all"), (F.col("all") - F.col("most.sets")).alias("others"))
        blocks = lambda c: F.ceil(F.col(c) / BLOCK)
        spread = staged(spread.select("*", blocks("others").alias("blocks_u"), blocks("all").alias("blocks_v")), "spread")
        block = lambda c: F.pmod(F.xxhash64("set_id", F.lit(c)), F.col(c))
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        held = now.join(spread, "h").join(known, "set_id")
        other = held.withColumn("block_v", block("blocks_v")).withColumn("block_u", every("blocks_u"))
        other = other.select("h", "block_u", "block_v", F.col("set_id").alias("v"), F.col("n").alias("n_v"), F.col("label").alias("label_v"), F.col("sketch").alias("sketch_v"), F.col("first").alias("first_v"))
        apart = (F.col("label") < F.col("label_v")) | ((F.col("label_v") == F.col("most")) & (F.col("label") != F.col("label_v")))
        before = F.array_min(F.array_intersect("first", "first_v")) < F.col("h")
        for part in self.parts(held, spread.agg(F.sum(F.col("others") * F.col("all")))):
            mine = part.where("label <> most").withColumn("block_u", block("blocks_u")).withColumn("block_v", every("blocks_v"))
            pairs = mine.join(other, ["h", "block_u", "block_v"]).where(apart & self.alike("n", "n_v") & self.may_link("sketch", "sketch_v", "n", "n_v") & ~F.coalesce(before, F.lit(False)))
            self.check(pairs.select(F.least("set_id", "v").alias("u"), F.greatest("set_id", "v").alias("v"), (F.col("n") + F.col("n_v")).alias("members")), sketched=True)
        drop_staged(known)
        drop_staged(now)
        drop_staged(spread)

    def run(self) -> DataFrame:
        """Links by fingerprints, then by hubs of widely held shingles, round after round, then by all pairs left apart.

        The first two leave fewer pairs for the last, which alone would find every link between components.
        """
        self.by_fingerprint()
        sizes = self.met.groupBy("h").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
        wide = staged(self.met.join(sizes.where(F.col("sets") > FEW), "h"), "wide")
        narrow = self.met.join(sizes.where(F.col("sets") <= FEW).select("h"), "h")
        k, any_wide = 0, not wide.isEmpty()
        if any_wide:
            while self.by_hub(wide, k) > MORE * self.n_links or not k % 2:
                k += 1
        self.by_pairs(narrow, wide.groupBy("set_id").agg(F.count(F.lit(1)).alias("wide")))
        if any_wide:
            self.by_rest(wide)
        out = self.components()
        for used in (self.met, self.whole, self.sets, wide, *self.found):
            drop_staged(used)
        return out


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, label, component_id): component_id is the smallest doc_id that links of that similarity reach.

    Every link counts. They are sought in three ways, each checked on whole sets: between fingerprints at most two bits
    apart; between the sets of each rare shingle that more than FEW hold and one of them, in rounds until one adds few
    links, which joins most of a large group of near copies without a square of its size; and between all pairs left
    apart that share a rare shingle, however many hold it. Null doc_ids count as no doc_id; texts without words are copies
    of each other; repeated rows each have a row.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    with shuffles_removed(docs.sparkSession):
        search = _Search(texts, size, percent)
        label = search.run()
    linked = search.rows.select("doc_id", "text_key", "set_id").join(label, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    least = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return linked.join(least, "label").select("doc_id", "text_key", "label", "component_id")


def one_of_each_similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document of each component, as in simhash.one_of_each."""
    found = similar_documents(docs, size, percent)
    with shuffles_removed(docs.sparkSession):
        return keep_one(docs, found)
