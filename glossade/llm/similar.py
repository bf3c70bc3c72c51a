"""Near-duplicates by similarity: every pair of texts that share 0.8 of their distinct five-word shingles, and no other.

First, SimHash fingerprints of the shingles by pigeonhole blocks (operator 9) bring close copies together, whole groups of
them in a few links. A fingerprint of 64 bits can't tell 0.8 from less, nor find all pairs at 0.8, so the rest is found by a
prefix filter, which is complete: with all shingles in one order, two texts at the similarity or above share one of the first
n - ceil(0.8 n) + 1 of each. Any order will do, so shingles that a sample shows to be common come last, and few texts meet
without cause. Texts that meet, and are in no group together yet, are linked coarsely by what can't be wrong: sizes, and the
parities of their shingles in 512 cells, which differ in no more cells than the texts do in shingles (long texts: in a sample
of them, and so by a bound that one true pair in 10**10 breaks). Each text is then in one coarse group, and within groups links
are verified on the shingle hashes themselves. What is larger than a task may be is compared block against block, every block
with every other.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import dropped, freed, map_texts, sampled, texts, written
from .simhash import links as simhash_links
from .simhash import majority, shingle_hashes

BITS, WORDS, SIMILARITY = 512, 5, 0.8
#: Texts sampled for common shingles, occurrences there that make one common, and the most of them that are held.
SAMPLE, COMMON, MOST_COMMON = 20_000, 4, 200_000
#: Tasks among which the texts of a common shingle are dealt.
SALTS = 64
#: Members of a bucket whose pairs are told one by one; of one that is compared in one task; larger ones are cut to blocks of about half as many.
SMALL, BUCKET = 8, 4096
#: Shingles of a coarse group that are compared in one task; larger ones are cut to blocks of about half as many.
SHINGLES = 2_000_000
#: Standard deviations above the mean that a sampled difference may have (texts of 512 shingles or more): one true pair in 10**10 has more.
DEVIATIONS = 8


def hashes_of(text: str, words: int = WORDS) -> tuple[np.ndarray, int]:
    """The distinct shingle hashes, ascending, and the SimHash fingerprint."""
    parts = [*shingle_hashes(text, words)]
    return (np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)), majority(parts)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    parts = [*shingle_hashes(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def level(n):
    """Long texts' cells hold one shingle in 2**level, so that 256 to 512 of them fall into cells."""
    return np.maximum(0, np.floor(np.log2(np.maximum(n, 1) / 256))).astype(np.int64)


def parities(h: np.ndarray) -> bytes:
    """BITS cells, each the parity of the shingles that fall into it, at the text's level and at the one below."""
    out = b""
    for k in (int(level(len(h))), max(0, int(level(len(h))) - 1)):
        x = h[h >> np.uint64(40) & np.uint64((1 << k) - 1) == 0]
        out += np.packbits((np.bincount((x % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()
    return out


def prefix(h: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """As many first shingles as a text at the similarity must share one of, by hash, then those in common (ascending) by rank; and how many are not common."""
    n = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
    if not len(common) or not len(h):
        return h[:n], min(n, len(h))
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    known = common[at] == h
    rare = h[~known]
    return np.concatenate([rare, h[known][np.argsort(rank[at[known]], kind="stable")]])[:n], min(n, len(rare))


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a bounded sample shows to be common, ascending, and their ranks from the rarest."""

    def run(batch: pa.RecordBatch, values: list[str]):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *(shingle_set(v, words) for v in values)]).view(np.int64))], names=["h"])

    found = map_texts(texts(sampled(docs, SAMPLE)), run, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    top = found.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toPandas()
    h = top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.arange(len(h), 0, -1)[order]


def fingerprints(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node (a hash of the shingle set), n, sim (SimHash), fp (parities), keys (prefix) and rare (so many of them are not common), a row a row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, words))

    def run(batch: pa.RecordBatch, values: list[str]):
        common, rank = shared.value
        sets, sims = zip(*(hashes_of(v, words) for v in values))
        keys, rare = zip(*(prefix(h, common, rank, similarity) for h in sets))
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], dtype=np.uint64).view(np.int64)
        cols = [pa.array(node), pa.array([len(h) for h in sets], pa.int64()), pa.array(np.array(sims, dtype=np.uint64).view(np.int64)), pa.array([parities(h) for h in sets], pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64))), pa.array(rare, pa.int32())], names=["doc_id", "node", "n", "sim", "fp", "keys", "rare"])

    return map_texts(texts(docs), run, "doc_id long, node long, n long, sim long, fp binary, keys array<long>, rare int")


def could(n: np.ndarray, fp: np.ndarray, n2: np.ndarray, fp2: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts with these shingle counts and parities (rows of 64-bit words) could be at the similarity: their counts allow it, and so do the cells that differ."""
    k, k2, half = level(n), level(n2), BITS // 64
    cells = np.where((k > k2)[:, None], fp[:, half:], fp[:, :half]) ^ np.where((k2 > k)[:, None], fp2[:, half:], fp2[:, :half])
    differ, least = np.bitwise_count(cells).sum(axis=1, dtype=np.int64), np.minimum(k, k2)
    allowed = (n + n2) * (1 - similarity) / (1 + similarity) / (1 << least)
    allowed = allowed + np.where(least > 0, DEVIATIONS * np.sqrt(allowed), 0)
    return (differ <= allowed + 1e-6) & (np.minimum(n, n2) >= similarity * np.maximum(n, n2) - 1e-6)


def forest(fp: np.ndarray, n: np.ndarray, similarity: float, sets: list[np.ndarray] | None = None, root: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs that join what links connect. fp: rows of 64-bit words (parities); n: shingle counts.

    Without sets a link is a pair that could be at the similarity, and what shares a root is linked already. With sets (shingle hashes of each) it
    is a pair that is at the similarity.
    """
    left, out = np.arange(len(fp)), []
    if sets is not None:
        size = np.array([len(x) for x in sets])
        start = np.cumsum(size) - size
        _, ids = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), return_inverse=True)
        mark = np.zeros(len(ids) + 1, dtype=bool)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            own = np.full(len(left), i)
            near = could(n[left], fp[left], n[own], fp[own], similarity)
            if sets is not None and near.any():
                mine = ids[start[i] : start[i] + size[i]]
                mark[mine] = True
                at = np.nonzero(near)[0]
                both = np.array([np.count_nonzero(mark[ids[start[j] : start[j] + size[j]]]) for j in left[at].tolist()])
                mark[mine] = False
                near[at] = both >= similarity * (size[left[at]] + size[i] - both) - 1e-6
            out += [(i, j) for j in left[near].tolist() if root is None or root[i] != root[j]]
            if root is not None:
                near |= root[left] == root[i]
            queue += left[near].tolist()
            left = left[~near]
    return out


def _words(column) -> np.ndarray:
    """Parities as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, BITS // 32)


def _links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of each row's forest; members are structs of node, n, fp and, where links are to be verified, h, else root."""
    exact = "h" in members.schema["members"].dataType.elementType.names

    def run(batches):
        for batch in batches:
            col = batch.column(0)
            for i in range(batch.num_rows):
                v = col[i].values
                node, first = np.unique(v.field(0).to_numpy(zero_copy_only=False), return_index=True)
                if len(node) < 2:
                    continue
                n = v.field(1).to_numpy(zero_copy_only=False)[first]
                if exact:
                    more = {"sets": [np.frombuffer(v.field(3)[k].as_py(), dtype=np.uint64) for k in first.tolist()]}
                else:
                    more = {"root": v.field(3).to_numpy(zero_copy_only=False)[first]}
                a, b = zip(*found) if (found := forest(_words(v.field(2))[first], n, similarity, **more)) else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(node[list(x)], pa.int64()) for x in (a, b)], names=["a", "b"])

    return members.select("members").mapInArrow(run, "a long, b long")


def _tested(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes that could be at the similarity."""
    side = lambda x: own.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("fp").alias(f"fp_{x}"))

    def run(batches):
        for t in batches:
            if t.num_rows:
                n, n2 = (t.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
                yield t.select(["a", "b"]).filter(pa.array(could(n, _words(t.column(3)), n2, _words(t.column(5)), similarity)))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "fp_a", "n_b", "fp_b").mapInArrow(run, "a long, b long")


def _blocked(df: DataFrame, by: str, blocks) -> DataFrame:
    """df with columns x and y, a row for each pair of blocks of its group that its node's block is in: all pairs of blocks meet."""
    p = F.greatest(F.lit(1).cast("long"), blocks)
    own = F.pmod(F.xxhash64("node", by), p)
    other = F.explode(F.sequence(F.lit(0).cast("long"), p - 1)).alias("other")
    dealt = df.select("*", p.alias("p"), own.alias("own"), other)
    # a block meets itself in each pair it is in; alone it stands only where it is the only one
    return dealt.where("own != other or p = 1").withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("p", "own", "other")


def _halves(size, most: int):
    """Blocks of about most / 2 for what is larger than most, else one."""
    return F.when(size > most, F.ceil(2 * size / most)).otherwise(F.lit(1)).cast("long")


def _close(own: DataFrame) -> DataFrame:
    """(a, b): nodes whose SimHash fingerprints are equal or linked by pigeonhole blocks."""
    distinct = written(own.groupBy("sim").agg(F.min("node").alias("least")), "sims")
    equal = own.select("sim", "node").join(distinct, "sim").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    of = lambda x: distinct.select(F.col("sim").alias(x), F.col("least").alias(f"least_{x}"))
    apart = simhash_links(distinct.select(F.col("sim").alias("fp"))).join(of("a"), "a").join(of("b"), "b")
    return equal.union(apart.select("least_a", "least_b"))


def _meeting(batches):
    """Rows (key, node, common) in order of key: those of keys that several rows have, and of all common ones."""
    last = None  # the last row, and whether the row before shares its key

    def out(key, node, tell):
        return pa.RecordBatch.from_arrays([pa.array(key[tell], pa.int64()), pa.array(node[tell], pa.int64())], names=["key", "node"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, common = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        before = False
        if last is not None:
            key, node, common = (np.append(x, y) for x, y in zip(last, (key, node, common)))
            before = last[3]
        same = np.concatenate([[before], key[1:] == key[:-1]])
        tell = same | np.append(same[1:], False) | common
        yield out(key[:-1], node[:-1], tell[:-1])
        last = (key[-1], node[-1], common[-1], same[-1])
    if last is not None:
        yield out(*(np.array([x]) for x in last[:2]), np.array([bool(last[2] or last[3])]))


def coarse(own: DataFrame, similarity: float) -> DataFrame:
    """(node, root): groups that hold every pair of nodes at the similarity, from a written table of fingerprints of different nodes."""
    spark = own.sparkSession
    close = written(_tested(_close(own), own, similarity), "close")
    roots = written(components(close), "close-roots")
    keyed = own.select("node", "rare", F.posexplode("keys").alias("pos", "key")).select("key", "node", (F.col("pos") >= F.col("rare")).alias("common"))
    salt = F.when(F.col("common"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    met = written(keyed.repartition(F.col("key"), salt).sortWithinPartitions("key").mapInArrow(_meeting, "key long, node long"), "met")
    freed(spark)
    rooted = written(met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted")
    dropped(met)
    size = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("key", "m")
    left = written(rooted.join(size, "key"), "apart")  # keys of texts that are in no group together yet
    dropped(rooted)
    freed(spark)
    few = left.where(F.col("m") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("node", "root")).alias("s"))
    pairs = few.select(F.explode(F.expr("flatten(transform(s, (x, i) -> transform(filter(slice(s, 1, i), y -> y.root != x.root), y -> struct(least(x.node, y.node) as a, greatest(x.node, y.node) as b))))")).alias("p")).select("p.*").distinct()
    dealt = _blocked(left.where(F.col("m") > SMALL), "key", _halves(F.col("m"), BUCKET))
    members = dealt.join(own.select("node", "n", "fp"), "node").groupBy("key", "x", "y").agg(F.collect_list(F.struct("node", "n", "fp", "root")).alias("members"))
    found = written(_tested(pairs, own, similarity).union(_links(members, similarity)).distinct(), "coarse")
    dropped(left)
    freed(spark)
    return components(close.union(found))


def links(docs: DataFrame, own: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(a, b): verified links that connect all nodes of own (written, one row a node, with doc_id and a text of docs) that pairs at the similarity connect."""
    grouped = written(coarse(own, similarity).join(own.select("node", "n", "doc_id"), "node"), "grouped")
    total = grouped.groupBy("root").agg(F.sum("n").alias("total"))
    wanted = grouped.join(total, "root").select("doc_id", "node", "root", "total")

    def run(batch: pa.RecordBatch, values: list[str]):
        sets = [shingle_set(v, words) for v in values]
        node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], dtype=np.uint64).view(np.int64)
        cols = [pa.array(node), pa.array([len(h) for h in sets], pa.int64()), pa.array([parities(h) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["node", "n", "fp", "h"])

    few = texts(docs).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = map_texts(few, run, "node long, n long, fp binary, h binary")
    dealt = _blocked(sets.join(wanted.select("node", "root", "total"), "node"), "root", _halves(F.col("total"), SHINGLES))
    members = dealt.groupBy("root", "x", "y").agg(F.collect_list(F.struct("node", "n", "fp", "h")).alias("members"))
    found = written(_links(members, similarity), "links")
    dropped(grouped)
    freed(own.sparkSession)
    return found


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id (the least doc_id of the group), one row a distinct doc_id; rows without a doc_id are left out.

    Null and empty texts are equal to one another. A doc_id with several texts joins the groups of all of them. Equal shingle sets are one node.
    """
    docs = docs.where("doc_id is not null")
    own = written(fingerprints(docs, words, similarity), "wide")
    nodes = written(own.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    same = written(own.select("doc_id", "node").distinct(), "same")
    once = written(own.join(nodes, "node").where("doc_id = least and n > 0").drop("least").dropDuplicates(["node"]), "once")
    dropped(own)
    freed(docs.sparkSession)
    found = [links(docs, once, similarity, words)]
    dropped(once)
    many = same.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    found.append(same.join(many, "doc_id").select("a", F.col("node").alias("b")))
    found = written(components(reduce(DataFrame.union, found)), "groups")
    rooted = nodes.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return same.join(rooted.select("node", "root"), "node").join(least, "root").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group left, that of the least doc_id; rows without a doc_id stay. Of rows that share the least doc_id the first by text stays."""
    kept = written(groups(docs, words, similarity).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")), "kept")
    out = docs.join(kept, docs.doc_id.cast("long") == kept.kept_id, "left_semi")
    twice = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if twice.isEmpty():
        first = out
    else:
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        one = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("kept_row")).select("kept_row.*")
        first = out.join(twice, "doc_id", "left_anti").unionByName(one)
    return first.unionByName(docs.where("doc_id is null"))
