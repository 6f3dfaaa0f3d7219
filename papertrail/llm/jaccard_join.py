"""Exact n-gram Jaccard join with count vectors in R-trees.

Documents become sets of distinct word shingles (64-bit hashes); documents
with equal sets are one node.  Two nodes link when
``num * |A ∪ B| <= den * |A ∩ B|``, i.e. Jaccard >= num / den.

1. Tiles.  Words and shingles are hashed into 2**17 groups each, whose
   totals over all documents order the shingles: rarest words first, and
   shingles of a crowded group (a passage in very many documents) last.
   Linked sets share one of the |A| - ceil(t |A|) + 1 first shingles of any
   such order, so these key the tiles of the point space; tiles of one node
   are dropped.
2. Points.  The shingles of a candidate are hashed into 256 groups; the
   counts are its point, of which trees see sums of four groups first.  The overlap of two points, or boxes of points, is
   at most the sum of their coordinate minima.
3. Stars.  A tile's centre is its smallest node.  Every node is first held,
   by that bound and then exactly, against the centre that it shares most
   tiles with; links give components.  Then, in the tiles that still hold
   several components, against the centres of other components.  A group of
   a million near copies costs one comparison per member, never all pairs.
4. R-trees.  Tiles that still hold several components bulk-load their
   points into an R-tree (sorted by size, 32 points a leaf); only pairs of
   different components that pass the bound are verified: in one search
   the best partner of each node, whose links join most components at the
   cost of one comparison per node, then every pair that is still between
   components.  Tiles are cut into chunks of ``chunk`` points, joined chunk
   by chunk, so one task's work is bounded.
5. Verification intersects the whole sets.  Members travel to their centre,
   which is repeated for every ``SALT`` members.

No candidate is capped; a missing link between two components is always
searched in step 4.

Defined cases: a null or wordless text has the empty set, links with
nothing and is its own component; a text shorter than ``words`` is one
shingle; rows that repeat an id are one node each and share the id; a
component whose ids are all null has a null id; extra columns are ignored;
empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import discard, lean, release, small, stored
from papertrail.llm.components import components
from papertrail.llm.wordhash import gram_hashes, hashed_words, mixed, slices

BITS = 17
CROWDED = 8  # times the mean total of a shingle group
DIMS = 256
COARSE = 64
FULL = 255  # a group count that may stand for more
LEAF = 32
ROUNDS = 1  # searches for the best partners before that for all
CHUNK = 2048
SALT = 500
MAX_BROADCAST_ROWS = 500_000
SLICE_BYTES = 1 << 20  # text whose shingles are in memory at once


def shingle_sets(texts: pa.Array, words: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(distinct shingle hashes of each text, ascending; the position of an
    occurrence of each; the hashes of all words)."""
    at, w = hashed_words(texts, lower=True)
    grams = gram_hashes(w, words)
    sets, places = [], []
    for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
        n = y - x
        if n >= words:
            h = grams[x:y - words + 1]
            by = np.argsort(h)
            h = h[by]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            sets.append(h[new])
            places.append(by[new] + x)
        elif n:  # a short text: its words and their number
            sets.append(gram_hashes(np.append(w[x:y], np.uint64(n)), n + 1)[:1])
            places.append(np.array([x]))
        else:
            sets.append(np.empty(0, "uint64"))
            places.append(np.empty(0, "int64"))
    return sets, places, w


def _group(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype("int64")


def _sid(h: np.ndarray) -> int:
    """64-bit digest of an ascending set, as a signed number."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))).view("int64"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def node_table(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, th, n, sid per row; totals: grp, total over all documents, of
    the word groups and then the shingle groups), written once from one pass."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "th", "n", "sid", "grp", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(2 << BITS, "int64")
        id_type = None
        for whole in batches:
            id_type = whole.schema.field(0).type
            for b in slices(whole, 2, SLICE_BYTES):
                sets, _, w = shingle_sets(b.column(2), words)
                totals[:1 << BITS] += np.bincount(_group(w), minlength=1 << BITS)
                totals[1 << BITS:] += np.bincount(_group(np.concatenate(sets)), minlength=1 << BITS)
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(h) for h in sets], pa.int32()),
                                                  pa.array(list(map(_sid, sets)), pa.int64()), none, none], names)
        if id_type is not None:
            g = np.flatnonzero(totals)
            no = lambda t: pa.nulls(len(g), t)
            yield pa.RecordBatch.from_arrays([no(id_type), no(pa.int64()), no(pa.int32()), no(pa.int64()),
                                              pa.array(g), pa.array(totals[g])], names)

    both = _keyed(docs, id_col, text_col).mapInArrow(lean(run), f"id {kind}, th long, n int, sid long, grp long, total long")
    both = stored(both, "jaccard-nodes")
    totals = both.filter("grp is not null").groupBy("grp").agg(F.sum("total").alias("total"))
    return both.filter("grp is null").select("id", "th", "n", "sid"), totals


def commonness(totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(quarter octaves of each word group's total, whether a shingle group is
    crowded): two numbers a group, whatever the corpus."""
    counts = np.zeros(2 << BITS, "int64")
    for r in totals.collect():
        counts[r["grp"]] = r["total"]
    of_words, of_shingles = counts[:1 << BITS], counts[1 << BITS:]
    return np.round(4 * np.log2(of_words + 1)).astype("uint16"), of_shingles > CROWDED * (of_shingles.mean() + 1)


def tile_keys(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str, words: int, num: int,
              den: int) -> DataFrame:
    """tile, sid: the prefix shingles of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, crowded = sent.value
        for whole in batches:
            for b in slices(whole, 2, SLICE_BYTES):
                sets, places, w = shingle_sets(b.column(2), words)
                of_word = np.append(of_words[_group(w)], np.zeros(words, "uint16")).astype("uint64")
                of_gram = sum(of_word[j:len(of_word) - words + j] for j in range(words))
                tiles, sids = [], []
                for h, at in zip(sets, places):
                    n = len(h)
                    take = n - -(-num * n // den) + 1
                    if n <= 1:
                        prefix = h
                    else:
                        rank = np.minimum(of_gram[at], np.uint64(2047)) + np.where(crowded[_group(h)], np.uint64(2048), np.uint64(0))
                        key = (rank << np.uint64(52)) | (h >> np.uint64(12))
                        prefix = h[np.argpartition(key, take - 1)[:take]] if take < n else h
                    tiles.append(prefix)
                    sids.append(np.full(len(prefix), _sid(h)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tiles).view("int64")), pa.array(np.concatenate(sids).astype("int64"))], ["tile", "sid"])

    return _keyed(docs, id_col, text_col).mapInArrow(lean(run), "tile long, sid long")


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two ascending sets link."""
    both = np.intersect1d(x, y, assume_unique=True).size
    return both > 0 and den * both >= num * (len(x) + len(y) - both)


def needed(a, b, num: int, den: int):
    """The smallest overlap with which sets of a and b shingles link."""
    return -(-num * (a + b) // (num + den))


def _may_overlap(va: np.ndarray, vb: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the sums of coordinate minima reach ``least``, row by row; where
    both counts of a group are full, the true minimum is unknown."""
    low = np.minimum(va, vb)
    return (low.sum(1, dtype="int64") >= least) | (low == FULL).any(1)


def within_bound(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that their points do not exclude."""
    p = points.select("sid", "n", "vec")
    j = pairs.join(p.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va")), "a")
    j = j.join(p.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb")), "b")
    j = j.filter(F.greatest("na", "nb") * num <= F.least("na", "nb") * den).select("a", "b", "na", "nb", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(k).to_numpy() for k in (2, 3))
            va, vb = (np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in b.column(k)), "uint8").reshape(-1, DIMS) for k in (4, 5))
            ok = _may_overlap(va, vb, needed(na.astype("int64"), nb, num, den))
            yield b.select([0, 1]).filter(pa.array(ok))

    return j.mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link.  ``texts``: sid, text.  Every b
    travels to its a, of which there is one for each SALT partners."""
    pairs = pairs.checkpoint()
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("parts"))
    member = pairs.join(parts, "a").select("a", F.pmod(F.hash("b"), F.col("parts")).alias("part"), F.col("b").alias("sid"),
                                           F.lit(1).alias("place"))
    centre = parts.select("a", F.explode_outer(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                          F.col("a").alias("sid"), F.lit(0).alias("place"))
    rows = member.unionByName(centre).join(texts.select("sid", "text"), "sid").select("a", "part", "place", "sid", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, "uint64")
        for whole in batches:
            for b in slices(whole, 4, SLICE_BYTES):
                ok = []
                for first, h in zip(b.column(2).to_pylist(), shingle_sets(b.column(4), words)[0]):
                    if first == 0:
                        own = h
                    ok.append(first == 1 and linked(own, h, num, den))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(lean(run), "a long, b long")


def overlap_bound_pairs(vec: np.ndarray, size: np.ndarray, comp: np.ndarray, side: np.ndarray, num: int,
                        den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of different components that an R-tree cannot exclude:
    the sum of coordinate minima must reach the overlap that a link needs.
    ``side``: with two values, only pairs across them."""
    order = np.lexsort((comp, size))
    fine, size, comp, side = vec[order], size[order].astype("int64"), comp[order], side[order]
    vec = fine.reshape(len(fine), COARSE, -1).sum(2, dtype="int32")
    vec[(fine == FULL).reshape(len(fine), COARSE, -1).any(2)] = 1 << 24  # full: no bound
    cuts = np.arange(0, len(vec), LEAF)
    high = np.maximum.reduceat(vec, cuts, axis=0)
    least, most = np.minimum.reduceat(size, cuts), np.maximum.reduceat(size, cuts)
    two = len(np.unique(side)) > 1
    found = []

    for i in range(len(cuts)):
        bound = np.minimum(high[i], high[i:]).sum(1)
        near = (bound >= needed(least[i], least[i:], num, den)) & (num * least[i:] <= den * most[i])
        a = np.arange(cuts[i], min(cuts[i] + LEAF, len(vec)))
        for k in (np.flatnonzero(near) + i).tolist():
            b = np.arange(cuts[k], min(cuts[k] + LEAF, len(vec)))
            ok = comp[a][:, None] != comp[b][None, :]
            if two:
                ok &= side[a][:, None] != side[b][None, :]
            if i == k:
                ok &= a[:, None] < b[None, :]
            if ok.any():
                ok &= num * np.maximum(size[a][:, None], size[b][None, :]) <= den * np.minimum(size[a][:, None], size[b][None, :])
                o = np.minimum(vec[a][:, None, :], vec[b][None, :, :]).sum(2)
                ok &= o >= needed(size[a][:, None], size[b][None, :], num, den)
                p, q = np.nonzero(ok)
                p, q = a[p], b[q]
                keep = _may_overlap(fine[p], fine[q], needed(size[p], size[q], num, den))
                if keep.any():
                    found.append((order[p[keep]], order[q[keep]]))
    if not found:
        return np.empty(0, "int64"), np.empty(0, "int64")
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def best_of_each(vec: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, block: int = 1 << 15) -> tuple[np.ndarray, ...]:
    """(node, partner, share) with every node's partner of the largest bounded
    overlap per shingle of the two; the pairs are (x, y)."""
    share = np.concatenate([np.minimum(vec[x[k:k + block]], vec[y[k:k + block]]).sum(1) for k in range(0, len(x), block)])
    share = share / (size[x].astype("int64") + size[y])
    node, partner, share = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([share, share])
    order = np.lexsort((partner, -share, node))
    order = order[np.append(True, np.diff(node[order]) != 0)]
    return node[order], partner[order], share[order]


def tree_candidates(members: DataFrame, points: DataFrame, num: int, den: int, chunk: int, best: bool = False) -> DataFrame:
    """Pairs (a, b) of different components within a tile that pass the bound,
    or of these only the ``best`` of every node.  ``members``: tile, sid, comp;
    ``points``: sid, n, vec.  Points travel once, when all else is settled."""
    parts = members.groupBy("tile").agg(F.count(F.lit(1)).alias("m")).select(
        "tile", F.greatest(F.lit(1), F.ceil(F.col("m") / chunk)).cast("int").alias("parts"))
    m = members.join(parts, "tile").withColumn("part", F.pmod(F.hash("sid"), F.col("parts")))
    # chunk i meets chunk j >= i in task (tile, i, j)
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(
        F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    m = m.withColumn("at", F.explode_outer(others)).select("tile", "at.i", "at.j", "part", "sid", "comp")
    m = m.join(points, "sid").select("tile", "i", "j", "part", "sid", "n", "comp", "vec")
    m = m.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch | None:
            _, part, sid, n, comp, vec = zip(*held)
            held.clear()
            if len(set(comp)) < 2:
                return None
            v = np.frombuffer(b"".join(vec), "uint8").reshape(len(vec), DIMS)
            x, y = overlap_bound_pairs(v, np.array(n), np.array(comp), np.array(part), num, den)
            if not len(x):
                return None
            s = np.array(sid, "int64")
            if best:
                x, y, share = best_of_each(v, np.array(n), x, y)
                return pa.RecordBatch.from_arrays([pa.array(s[x]), pa.array(s[y]), pa.array(share)], ["node", "partner", "share"])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(s[x], s[y])), pa.array(np.maximum(s[x], s[y]))], ["a", "b"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(8)]
            for tile, i, j, *rest in zip(*cols):
                if held and held[0][0] != (tile, i, j):
                    if (out := close()) is not None:
                        yield out
                held.append(((tile, i, j), *rest))
        if held and (out := close()) is not None:
            yield out

    if best:
        found = m.mapInArrow(lean(run), "node long, partner long, share double")
        found = found.groupBy("node").agg(F.max(F.struct("share", "partner")).alias("x")).select("node", "x.partner")
        return found.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct()
    return m.mapInArrow(lean(run), "a long, b long").distinct()


def candidate_points(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """sid, n, text and vec (the set's counts in DIMS groups) of the wanted
    nodes, from one document of each."""
    rows = nodes.groupBy("sid", "id", "th").agg(F.count(F.lit(1)).alias("m"))
    one = rows.groupBy("sid").agg(F.min(F.struct("id", "th", "m")).alias("doc")).join(wanted, "sid").select(
        "sid", "doc.id", "doc.th", (F.col("doc.m") > 1).alias("again"))
    d = _keyed(docs, id_col, text_col)
    one = small(one.checkpoint(), MAX_BROADCAST_ROWS)
    d = d.join(one, d["id"].eqNullSafe(one["id"]) & (d["th"] == one["th"])).select("sid", "text", "again")
    # only where the table repeats a row is there a choice to make, and a shuffle
    once = d.filter("not again").select("sid", "text")
    if not one.filter("again").isEmpty():
        once = once.unionByName(d.filter("again").select("sid", "text").dropDuplicates(["sid"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                sets = shingle_sets(b.column(1), words)[0]
                vec = [np.minimum(np.bincount((mixed(h) % np.uint64(DIMS)).astype("int64"), minlength=DIMS), FULL)
                       .astype("uint8").tobytes() for h in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int32()), b.column(1),
                                                  pa.array(vec, pa.binary())], ["sid", "n", "text", "vec"])

    return once.mapInArrow(lean(run), "sid long, n int, text string, vec binary")


def open_members(members: DataFrame, comps: DataFrame) -> DataFrame:
    """tile, sid, centre, comp and centre_comp of the tiles whose nodes are of
    several components.  ``members``: tile, sid, centre; ``comps``: node, comp."""
    of = small(comps, MAX_BROADCAST_ROWS)
    m = members.join(of.select(F.col("node").alias("sid"), "comp"), "sid", "left")
    m = m.join(of.select(F.col("node").alias("centre"), F.col("comp").alias("centre_comp")), "centre", "left")
    m = m.select("tile", "sid", "centre", F.coalesce("comp", "sid").alias("comp"),
                 F.coalesce("centre_comp", "centre").alias("centre_comp"))
    # a tile's centre is one of its nodes
    several = m.filter("comp <> centre_comp").select("tile").distinct()
    return m.join(several, "tile", "left_semi")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 9,
                       den: int = 10, chunk: int = CHUNK) -> DataFrame:
    """Per row: the id column, th (xxhash64 of the text), n_shingles, component
    (a node of it) and component_id, the smallest id reachable by links of
    Jaccard >= num / den."""
    nodes, totals = node_table(docs, id_col, text_col, words)
    tiles = stored(tile_keys(docs, commonness(totals), id_col, text_col, words, num, den), "jaccard-tiles")
    shared = tiles.groupBy("tile").agg(F.min("sid").alias("centre"), F.max("sid").alias("last")).filter("centre <> last")
    members = stored(tiles.join(shared.select("tile", "centre"), "tile").distinct(), "jaccard-members")
    discard(tiles)
    points = stored(candidate_points(docs, nodes, members.select("sid").distinct(), id_col, text_col, words), "jaccard-points")
    release(docs.sparkSession)
    # each node against the centre that it shares most tiles with
    shares = members.filter("sid <> centre").groupBy(F.col("centre").alias("a"), F.col("sid").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"))
    first = stored(shares.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select("best.a", "b"), "jaccard-pairs")
    links = stored(verified(within_bound(first, points, num, den), points, words, num, den), "jaccard-links")
    release(docs.sparkSession)
    comps = stored(components(links), "jaccard-comps")
    # the centres of other components, in the tiles that hold several
    open_ = stored(open_members(members, comps), "jaccard-open")
    discard(members)
    rest = open_.filter("comp <> centre_comp").select(F.col("centre").alias("a"), F.col("sid").alias("b")).distinct()
    rest = stored(rest.join(first, ["a", "b"], "left_anti"), "jaccard-pairs")
    more = stored(verified(within_bound(rest, points, num, den), points, words, num, den), "jaccard-links")
    release(docs.sparkSession)
    if not more.isEmpty():
        links = links.unionByName(more)
        comps = stored(components(links), "jaccard-comps")
        open_ = open_members(open_.select("tile", "sid", "centre"), comps)
    # what is left of those tiles, by trees: the best partner of each node,
    # while that joins components, and at last every pair between components
    tested = first.unionByName(rest)
    for best in [True] * ROUNDS + [False]:
        pairs = tree_candidates(open_.select("tile", "sid", "comp"), points.select("sid", "n", "vec"), num, den, chunk, best)
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
        release(docs.sparkSession)  # the points in their tiles, before texts travel
        more = stored(verified(pairs, points, words, num, den), "jaccard-links")
        release(docs.sparkSession)
        tested = tested.unionByName(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = stored(components(links), "jaccard-comps")
            open_ = open_members(open_.select("tile", "sid", "centre"), comps)
    discard(points)
    # every node to its component, every component to its smallest id
    n = nodes.join(comps, nodes["sid"] == comps["node"], "left").select(
        "id", "th", "n", F.coalesce("comp", "sid").alias("comp"))
    least = n.filter("n > 0").groupBy("comp").agg(F.min("id").alias("least"))
    out = n.join(stored(least, "jaccard-least"), "comp", "left")
    return out.select(F.col("id").alias(id_col), "th", F.col("n").cast("long").alias("n_shingles"),
                      F.col("comp").alias("component"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5,
                **options) -> DataFrame:
    """The rows of ``docs``, unchanged, with the smallest (id, text hash) of
    each component, nulls last; documents without words all stay."""
    c = stored(jaccard_components(docs, id_col, text_col, words, num, den, **options).filter("n_shingles > 0").select(
        F.col(id_col).alias("_id"), F.col("th").alias("_th"), "component"), "jaccard-components")
    rank = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_th"))
    best = c.groupBy("component").agg(F.min(rank).alias("best"), F.max(rank).alias("last")).filter("best <> last")
    gone = c.join(best, "component").filter(rank != F.col("best")).select("_id", "_th").distinct()
    gone = small(gone.checkpoint(), MAX_BROADCAST_ROWS)
    d = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"),
                    F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"))
    return d.join(gone, d["_id"].eqNullSafe(gone["_id"]) & (d["_th"] == gone["_th"]), "left_anti").select("_row.*")
