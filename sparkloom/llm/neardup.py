"""Operator 10: near-duplicate groups by bottom-k sketches from one hash function.

1. A document's set is its distinct word shingles, hashed to 63 bits. Documents with equal sets (copies) form one class
   and go on as one node, so a group of copies costs as much as one document.
2. A node's sketch holds its k smallest hashes. Inverted lists of the retained values generate overlaps. Values are
   ordered by how many nodes retain them: two sets with a similarity of 0.75 share at least ``least_shared``
   of the k values (23 of 64; chance of fewer: below 1e-11; exact for sets smaller than the sketch), so they share one of the rarest
   k - 23 + 1, and only those are listed. Common passages are last in that order and make no long lists.
   A list is also split by size class, as sizes must be within the threshold of each other.
3. Lists are not expanded into pairs. In a star round every list with more than one component compares all its
   nodes to a few of them, which then leave it; what is verified is merged. Groups of near copies collapse there with a
   few pairs per node. Then the pairs of different components that short lists (``MOST``) still hold are compared.
   Longer ones hold texts that share a passage which is a large part of each. For their nodes, lists are made again from the
   whole sets, where the prefix is exact, the rarest quarter of a set, and positions bound overlaps. They go through a few
   star rounds too, with more hubs, and then, if many pairs are left, through rounds of random groups with one hub each, as long
   as these link one node in ``FRUITFUL``. One hub of a star round is the node with the least share of values of its own. All pairs of different components that are left then are compared. Pairs inside a component
   cannot change the result, so no link between components is lost.
4. A pair is first estimated from the bottom k of the union of both sketches, and dropped if that is more than seven standard errors below
   the threshold. What is left is verified on the full sets, recomputed from the whole texts.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; a text with fewer words than a
shingle has its word sequence as its one shingle; rows that repeat an id are separate members of one group if they
link; a row with a null id never represents a group that has an id; an empty table gives no rows; other columns are
never read. Two different shingles share a 63-bit hash with a chance of about 1e-19 for each pair compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import kernels as K
from .components import components, merged

SKETCH = 64
#: Hubs of a star round, of one over crowded lists, and the longest list that is not crowded. None of them decides a link.
HUBS, CROWD_HUBS, MOST = 3, 8, 32
#: Star rounds over crowded lists go on while they leave more than so many pairs an entry; they and random rounds, while they link one node in so many.
ENOUGH, FRUITFUL = 1, 64
#: Star rounds over crowded lists at most.
CROWD_ROUNDS = 3


def least_shared(keep: int, percent: int) -> int:
    """How many of ``keep`` retained values two sets at the threshold share, seven standard errors below the mean."""
    p = percent / 100
    return max(1, int(keep * p - 7 * (keep * p * (1 - p)) ** 0.5))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block, ascending within each document: (hashes, document of each, number in each)."""
    starts, ends = K.words(data, bounds, ~K.BLANK)
    word = K.span_hash(data, starts, ends, K.LOWER)
    hashes, size = K.shingles(word, K.counts(starts, bounds), k)
    hashes >>= np.uint64(1)  # the same order for signed and unsigned integers
    doc = np.repeat(np.arange(len(size)), size)
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order], kind="stable")]
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[first], doc[first]
    return hashes, doc, np.bincount(doc, minlength=len(size))


def sketches(docs: DataFrame, k: int, keep: int) -> DataFrame:
    """(id, digest, n, a, b, sketch) of each row of (id, text, digest); a and b identify the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds, _ in K.blocks(batch.column(1)):
                h, doc, n = shingle_sets(data, bounds, k)
                begin = np.cumsum(n) - n
                a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                some = n > 0
                if some.any():
                    a[some] = np.add.reduceat(K.mix(h ^ np.uint64(0x5851F42D4C957F2D)), begin[some])
                    b[some] = np.bitwise_xor.reduceat(K.mix(h + np.uint64(0x14057B7EF767814F)), begin[some])
                low = np.arange(len(h)) - begin[doc] < keep
                at = np.concatenate([[0], np.cumsum(np.minimum(n, keep))]).astype(np.int32)
                rows = slice(first, first + len(n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(2)[rows], pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(h[low].view(np.int64)))],
                    names=["id", "digest", "n", "a", "b", "sketch"],
                )

    return docs.mapInArrow(run, "id long, digest binary, n long, a long, b long, sketch array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    rows = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "text_u", "text_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached: tuple[int, np.ndarray] | None = None  # rows arrive sorted by u: a hub's set is made once

        def whole(text: pa.Scalar) -> np.ndarray:
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            return shingle_sets(raw, np.array([0, len(raw)]), k)[0]

        for b in batches:
            good = np.zeros(len(b), bool)
            for i, u in enumerate(b.column(0).to_pylist()):
                if cached is None or cached[0] != u:
                    cached = u, whole(b.column(2)[i])
                x, y = cached[1], whole(b.column(3)[i])
                both = np.intersect1d(x, y, assume_unique=True).size
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, keep: int = SKETCH) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept) for every row; digest is the MD5 of its text."""
    spark = common.session(docs.sparkSession)
    used: list[str] = []
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("digest", F.unhex(F.md5("text")))
    rows = common.staged(sketches(base, k, keep), "sketches", used)
    nodes = rows.where("n > 0").groupBy("a", "b", "n").agg(F.min("id").alias("least_id"), F.min(F.struct("digest", "sketch")).alias("s"))
    nodes = common.staged(nodes.select(F.monotonically_increasing_id().alias("node"), "a", "b", "n", "least_id", "s.digest", "s.sketch"), "nodes", used)

    lists = common.staged(_lists(nodes, keep, percent), "lists", used)
    listed = nodes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "digest", "sketch")
    texts = base.select("digest", "text").dropDuplicates(["digest"]).join(listed.select("digest", "node"), "digest")
    texts = common.staged(texts.select("node", "text"), "texts", used)
    sketch = common.staged(listed.select("node", "sketch"), "listed", used)
    labels = _merge(lists, texts, sketch, k, percent, keep, used)

    whole = nodes.join(labels, "node", "left").select("a", "b", "n", "least_id", F.coalesce("comp", "node").alias("comp"))
    least = whole.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of = whole.join(least, "comp").select("a", "b", "n", "component_id")
    of = common.staged(of, "components")
    out = rows.select("id", "digest", "n", "a", "b").join(of, ["a", "b", "n"], "left")
    out = out.select(F.col("id").alias("doc_id"), "digest", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    common.drop(spark, *(p for p in used if "/sketches-" not in p))
    return out


def _lists(nodes: DataFrame, keep: int | None, percent: int) -> DataFrame:
    """(v, s, node, n, pos, far): the entries of the inverted lists, by value and size class, that hold at least two nodes.

    ``keep`` is the sketch size, or None where ``sketch`` is the whole set; ``pos`` is then the number of rarer values
    in the set, else 0. ``far`` is the share of a node's values that no other node has, in thousandths.
    """
    entries = nodes.select("node", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    common_ = entries.join(shared, "v").groupBy("node", "n", "m").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"))
    least = F.ceil(F.col("m") * percent / 100)
    if keep is not None:
        least = F.when(F.col("m") < keep * percent // 100, least).otherwise(F.lit(least_shared(keep, percent)))
    # a value of its own takes a place before all shared ones
    room = ((F.col("m") - least + 1) - (F.col("m") - F.size("vs"))).cast("int")
    far = ((F.col("m") - F.size("vs")) * 1000 / F.col("m")).cast("int")
    rare = common_.withColumn("room", room).where("room > 0").select("node", "n", (F.col("m") - F.size("vs")).alias("own"), far.alias("far"), F.posexplode(F.slice("vs", F.lit(1), F.col("room"))).alias("at", "x"))
    # sets within the threshold of each other have the same size class or neighbouring ones
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    pos = F.lit(0) if keep is not None else F.col("own") + F.col("at")
    both = rare.select(F.col("x.v").alias("v"), "node", "n", size.alias("s"), pos.cast("long").alias("pos"), "far")
    return both.select("v", F.explode(F.array("s", F.col("s") + 1)).alias("s"), "node", "n", "pos", "far")


def _full_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, n, sketch) of (node, text), the sketch being the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, bounds, _ in K.blocks(b.column(1)):
                h, _, n = shingle_sets(data, bounds, k)
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0)[first : first + len(n)], pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], names=["node", "n", "sketch"])

    return texts.mapInArrow(run, "node long, n long, sketch array<long>")


class _Merge:
    """The components found so far, and the verification of pairs that extends them."""

    def __init__(self, texts: DataFrame, sketch: DataFrame, k: int, percent: int, keep: int, used: list[str]):
        self.texts, self.sketch, self.k, self.percent, self.keep, self.used = texts, sketch, k, percent, keep, used
        self.links: DataFrame | None = None
        self.tried: DataFrame | None = None
        self.labels = texts.sparkSession.createDataFrame([], "node long, comp long")

    def labelled(self, lists: DataFrame) -> DataFrame:
        return lists.select("v", "s", "node", "n", "pos", "far", *(c for c in ("many",) if c in lists.columns)).join(self.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def verify(self, pairs: DataFrame, last: bool = False) -> int:
        """Compare the pairs (u, w, nu, nw, pu, pw) that were not compared before; u is the node that many of them share.

        Returns how many of them are links; after the ``last`` call nobody reads the components found so far.

        In the list of the rarest value that two sets share, all that they share lies at or after it, so the remaining
        sizes bound the overlap; without positions this is the bound by sizes alone.
        """
        fits = F.least(F.col("nu") - F.col("pu"), F.col("nw") - F.col("pw")) * (100 + self.percent) >= (F.col("nu") + F.col("nw")) * self.percent
        pairs = pairs.where(fits).select(F.least("u", "w").alias("x"), F.greatest("u", "w").alias("y"), "u").groupBy("x", "y").agg(F.min("u").alias("u"))
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["x", "y"], "left_anti")
        pairs = common.staged(pairs, "pairs", self.used)
        ends = pairs.select("u", (F.col("x") + F.col("y") - F.col("u")).alias("v"))
        good = common.staged(_verify(_estimated(ends, self.sketch, self.percent, self.keep), self.texts, self.k, self.percent), "links", self.used)
        self.tried = pairs.select("x", "y") if self.tried is None else self.tried.unionByName(pairs.select("x", "y"))
        linked = good.count()
        if linked:
            self.links = good if self.links is None else self.links.unionByName(good)
            # two steps save most comparisons that cannot change the result; the last call settles the rest
            if not last:
                self.labels = common.staged(merged(self.labels, good), "labels", self.used)
        return linked

    def settled(self) -> DataFrame:
        """(node, comp) of every node that has a link."""
        return self.labels if self.links is None else components(self.links)

    def star(self, lists: DataFrame, many: int = HUBS) -> tuple[DataFrame, DataFrame, int] | None:
        """A star round; returns the entries of lists that still hold several components, these lists, and the number of new links, or None.

        ``many`` nodes of each list are compared with all others in it and then leave it, since all their pairs there
        are done. One hub is the node with the least share of values of its own: near copies of one text, each with changes
        of its own, link with the one that is nearest to that text rather than with each other. The other hubs are random nodes of
        random components, so stragglers become hubs as soon as a large component does.
        """
        open_ = self.labelled(lists)
        hubs = [F.min(F.struct(F.col("far").cast("long") if not i else F.xxhash64("comp", F.lit(i)), F.xxhash64("node", F.lit(i)), "node", "n", "comp", "pos")) for i in range(many)]
        mixed = open_.groupBy("v", "s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.array_distinct(F.array(*(F.struct(*(h[c].alias(c) for c in ("node", "n", "comp", "pos"))) for h in hubs))).alias("hubs"))
        mixed = mixed.where("lo <> hi").select("v", "s", "hubs")
        left = common.staged(open_.join(mixed, ["v", "s"]), "lists", self.used)
        stars = left.select("node", "n", "comp", "pos", F.explode("hubs").alias("hub")).where("comp <> hub.comp")
        linked = self.verify(stars.select(F.col("hub.node").alias("u"), F.col("node").alias("w"), F.col("hub.n").alias("nu"), F.col("n").alias("nw"), F.col("hub.pos").alias("pu"), F.col("pos").alias("pw")))
        others = left.where(~F.exists("hubs", lambda h: h["node"] == F.col("node")))
        if not others.limit(1).count():
            return None
        open_ = common.staged(self.labelled(others), "lists", self.used)
        # entries that could still meet a partner of their own size
        near = F.count_if(F.col("pos") * (100 + self.percent) <= F.col("n") * (100 - self.percent))
        sizes = open_.groupBy("v", "s", "comp").agg(F.count("*").alias("c"), near.alias("e")).groupBy("v", "s")
        sizes = sizes.agg(F.sum("c").alias("many"), F.max("c").alias("top"), F.sum("e").alias("near"), F.max("e").alias("near_top")).where("many > top")
        return open_, common.staged(sizes, "sizes", self.used), linked

    def forget(self) -> None:
        """Delete the lists and sizes of earlier rounds."""
        old = [[p for p in self.used if f"/{label}-" in p][:-1] for label in ("lists", "sizes")]
        common.drop(self.texts.sparkSession, *old[0], *old[1])
        self.used[:] = [p for p in self.used if p not in old[0] + old[1]]

    def mingle(self, lists: DataFrame, salt: int) -> int:
        """Deal the entries of lists (with their length ``many``) into random groups, and compare each group to one of its own.

        That takes a pair an entry, splits long lists over tasks, and joins what star rounds have left apart.
        """
        dealt = self.labelled(lists).withColumn("group", F.pmod(F.xxhash64("node", F.lit(salt)), F.greatest(F.floor(F.col("many") / MOST), F.lit(1))))
        hub = dealt.groupBy("v", "s", "group").agg(F.min(F.struct(F.xxhash64("node", F.lit(salt + 1)), "node", "n", "comp", "pos")).alias("hub"))
        both = dealt.join(hub, ["v", "s", "group"]).where("comp <> hub.comp")
        return self.verify(both.select(F.col("hub.node").alias("u"), F.col("node").alias("w"), F.col("hub.n").alias("nu"), F.col("n").alias("nw"), F.col("hub.pos").alias("pu"), F.col("pos").alias("pw")))

    def rest(self, lists: DataFrame, last: bool = False) -> None:
        """Compare all pairs of different components within the lists."""
        side = lambda x: lists.select("v", "s", F.col("node").alias(x), F.col("comp").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"))
        self.verify(side("u").join(side("w"), ["v", "s"]).where("u < w AND cu <> cw"), last)


def _merge(lists: DataFrame, texts: DataFrame, sketch: DataFrame, k: int, percent: int, keep: int, used: list[str]) -> DataFrame:
    """(node, comp) of every node that has a link."""
    merge = _Merge(texts, sketch, k, percent, keep, used)
    found = merge.star(lists)
    if found is None:
        return merge.settled()
    left, sizes, _ = found
    merge.rest(left.join(sizes.where(F.col("many") <= MOST), ["v", "s"]))
    crowd = left.join(sizes.where(F.col("many") > MOST), ["v", "s"], "left_semi").select("node").distinct()
    crowd = common.staged(texts.join(crowd, "node", "left_semi"), "crowd", used)
    nodes = crowd.count()
    if not nodes:
        return merge.settled()
    left = common.staged(_lists(_full_sets(crowd, k), None, percent), "lists", used)
    merge.forget()
    for _ in range(CROWD_ROUNDS):
        found = merge.star(left, CROWD_HUBS)
        if found is None:
            return merge.settled()
        left, sizes, linked = found
        merge.forget()
        n = sizes.agg(F.sum("many").alias("entries"), F.sum(F.col("near") * (F.col("near") - F.col("near_top"))).alias("pairs")).first()
        few = (n.pairs or 0) <= ENOUGH * (n.entries or 0)
        if linked * FRUITFUL < nodes or few:
            break
    left = common.staged(left.drop("comp").join(sizes.select("v", "s", "many"), ["v", "s"]), "lists", used)
    merge.forget()
    salt = 0
    while not few and merge.mingle(left, salt) * FRUITFUL >= nodes:
        salt += 2
    left = merge.labelled(left)
    open_ = left.groupBy("v", "s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    merge.rest(left.join(open_, ["v", "s"]), last=True)
    return merge.settled()


def _estimated(pairs: DataFrame, sketch: DataFrame, percent: int, keep: int) -> DataFrame:
    """The pairs whose union sketch does not rule the threshold out."""
    side = lambda x: sketch.select(F.col("node").alias(x), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u")
    union = F.slice(F.array_sort(F.array_union("s_u", "s_v")), 1, keep)
    shared = F.size(F.array_intersect(F.array_intersect("s_u", "s_v"), F.col("top")))
    floor = percent / 100 - 7 * (percent / 100 * (1 - percent / 100) / keep) ** 0.5
    return both.withColumn("top", union).where((shared >= F.size("top") * F.lit(floor))).select("u", "v")
