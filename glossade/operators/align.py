"""Cross-lingual matching by cosine, and its permutation null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import draw

#: The seeds, a stated and small query set, are broadcast below this many; beyond it they are dealt by hash.
SEEDS_BROADCAST = 10_000


def unit(v: Column) -> Column:
    """The vector in double precision at length 1; null for a zero vector."""
    v = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def ranked_targets(targets: DataFrame, order: list[Column]) -> DataFrame:
    """Adds lpr_rank, from 1, within lang."""
    return targets.withColumn("lpr_rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))


# Languages that are no targets (the seeds' own, and one left out).
NO_TARGETS = ("en", "hu")


def guarded_targets(tables: DataFrame, excluded: tuple[str, ...] = NO_TARGETS) -> DataFrame:
    """Rows of word tables (lang, key, lpr_guard_ok, count_ratio_MH) that can be targets, with lpr_rank: what passes the guard, by log ratio, in all languages but the excluded."""
    own = tables.where((F.col("lpr_guard_ok") == 1) & ~F.col("lang").cast("string").isin(*excluded))
    return ranked_targets(own, [F.desc("count_ratio_MH"), F.col("key")])


def similarities(seeds: DataFrame, targets: DataFrame, most: int | None) -> DataFrame:
    """(seed, lang, target, lpr_rank, cosine) of all seeds (seed, vec) with each language's best `most` targets (lang, target, lpr_rank, vec), or with all of them."""
    left = seeds.select("seed", unit(F.col("vec")).alias("u"))
    within = targets if most is None else targets.where(F.col("lpr_rank") <= most)
    right = within.select("lang", "target", "lpr_rank", unit(F.col("vec")).alias("v"))
    if left.limit(SEEDS_BROADCAST + 1).count() <= SEEDS_BROADCAST:
        left = F.broadcast(left)
    met = right.crossJoin(left)
    return met.select("seed", "lang", "target", "lpr_rank", dot(F.col("u"), F.col("v")).alias("cosine"))


def restricted(pairs: DataFrame, ks: list[int], floor: float = 0.3) -> DataFrame:
    """(seed, lang, matched, cosine, lpr_rank, max_cos_<k>..., hit_at_<k>...): the best target, ties to the best rank, the best cosine within each k, and whether that reaches the floor."""
    best = F.max_by(F.struct("target", "cosine", "lpr_rank"), F.struct(F.col("cosine"), -F.col("lpr_rank")))
    own = pairs.groupBy("seed", "lang").agg(best.alias("best"), *(F.max(F.when(F.col("lpr_rank") <= k, F.col("cosine"))).alias(f"max_cos_{k}") for k in ks))
    hits = [F.coalesce(F.col(f"max_cos_{k}") >= floor, F.lit(False)).cast("int").alias(f"hit_at_{k}") for k in ks]
    return own.select("seed", "lang", F.col("best.target").alias("matched"), F.col("best.cosine").alias("cosine"), F.col("best.lpr_rank").alias("lpr_rank"), *(f"max_cos_{k}" for k in ks), *hits)


def unrestricted(pairs: DataFrame, ks: list[int], floor: float) -> DataFrame:
    """The global best target of each seed and language; below the floor there is no match. hit_at_<k>: whether its rank is within k."""
    best = F.max_by(F.struct("target", "cosine", "lpr_rank"), F.struct(F.col("cosine"), -F.col("lpr_rank")))
    own = pairs.groupBy("seed", "lang").agg(best.alias("b"))
    ok = F.col("b.cosine") >= floor
    return own.select("seed", "lang", F.when(ok, F.col("b.target")).alias("matched"), F.col("b.cosine").alias("cosine"), F.when(ok, F.col("b.lpr_rank")).alias("lpr_rank"), *((ok & (F.col("b.lpr_rank") <= k)).cast("int").alias(f"hit_at_{k}") for k in ks))


#: Vectors of a block: a product of two blocks is 4 MB or less.
BLOCK = 512


def searched(seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """(seed, lang, target, lpr_rank, cosine): each seed's best of all targets of each language, ties to the best rank, as unrestricted() picks it from similarities().

    All pairs are compared, as products of blocks in the tasks that hold the blocks; what goes on is a row a seed, language and block of targets. Of
    equal vectors of a language the best rank alone is compared. Cosines within 1e-9 of a block's best are summed again in the order of the vector, so that equal
    vectors have equal cosines wherever they stand.
    """
    left = seeds.select("seed", unit(F.col("vec")).alias("u"))
    right = targets.select("lang", "target", "lpr_rank", unit(F.col("vec")).alias("v")).groupBy("lang", "v").agg(F.min_by(F.struct("target", "lpr_rank"), "lpr_rank").alias("t"))
    kind = {c: targets.schema[c].dataType.simpleString() for c in ("lang", "target", "lpr_rank")} | {"seed": seeds.schema["seed"].dataType.simpleString()}
    n = (F.count("*") / BLOCK).cast("int") + 1
    block = lambda vec: F.pmod(F.xxhash64(vec), F.col("n"))
    a = left.crossJoin(F.broadcast(left.agg(n.alias("n")))).groupBy(block("u"), F.col("u").isNull().alias("a_void")).agg(F.collect_list(F.struct("seed", "u")).alias("a")).select("a_void", "a")  # one row
    sizes = F.broadcast(right.groupBy("lang").agg(n.alias("n")))  # a row a language
    b = right.join(sizes, "lang").groupBy("lang", block("v"), F.col("v").isNull().alias("b_void")).agg(F.collect_list(F.struct("t.target", "t.lpr_rank", "v")).alias("b")).select("lang", "b_void", "b")
    met = a.crossJoin(b.repartition(4 * seeds.sparkSession.sparkContext.defaultParallelism))

    def best(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                x, y = one["a"].values, one["b"].values
                seed, target, rank = x.field("seed"), y.field("target"), np.asarray(y.field("lpr_rank"))
                if one["a_void"].as_py() or one["b_void"].as_py():
                    at, cosine = np.full(len(seed), int(rank.argmin())), pa.nulls(len(seed), pa.float64())
                else:
                    u = np.asarray(x.field("u").flatten()).reshape(len(seed), -1)
                    v = np.asarray(y.field("v").flatten()).reshape(len(target), -1)
                    near = u @ v.T
                    i, j = np.nonzero(near >= near.max(axis=1, keepdims=True) - 1e-9)
                    exact = np.zeros(len(i))
                    for d in range(u.shape[1]):
                        exact += u[i, d] * v[j, d]
                    order = np.lexsort((rank[j], -exact, i))
                    first = order[np.unique(i[order], return_index=True)[1]]
                    at, cosine = j[first], pa.array(exact[first])
                yield pa.RecordBatch.from_arrays([seed, pa.array([one["lang"].as_py()] * len(seed), batch.schema.field("lang").type), target.take(pa.array(at)), pa.array(rank[at], y.field("lpr_rank").type), cosine], ["seed", "lang", "target", "lpr_rank", "cosine"])

    return met.mapInArrow(best, f"seed {kind['seed']}, lang {kind['lang']}, target {kind['target']}, lpr_rank {kind['lpr_rank']}, cosine double")


def seed_summary(matches: DataFrame, ks: list[int], examples: int = 3) -> DataFrame:
    """By seed: mean best cosine at each k (of restricted matches), the number of languages with a hit at each k, and its best matches as lang:target."""
    top = F.slice(F.reverse(F.array_sort(F.collect_list(F.when(F.col("matched").isNotNull(), F.struct("cosine", "lang", "matched"))))), 1, examples)
    means = [F.avg(f"max_cos_{k}").alias(f"mean_max_cos_{k}") for k in ks if f"max_cos_{k}" in matches.columns]
    hits = [F.sum(f"hit_at_{k}").alias(f"n_langs_hit_{k}") for k in ks]
    return matches.groupBy("seed").agg(*means, *hits, F.array_join(F.transform(top, lambda x: F.concat(x["lang"].cast("string"), F.lit(":"), x["matched"].cast("string"))), "; ").alias("example_matches"))


def lang_summary(matches: DataFrame, ks: list[int]) -> DataFrame:
    return matches.groupBy("lang").agg(F.count("*").alias("n_seeds"), *(F.avg(f"max_cos_{k}").alias(f"mean_max_cos_{k}") for k in ks))


def word_values(matches: DataFrame, ks: list[int]) -> DataFrame:
    """(seed, mean_cos_<k>..., hit_at_<k>...): means over languages of the best cosine (unrestricted matches: the same at each k) and of hits."""
    cos = lambda k: f"max_cos_{k}" if f"max_cos_{k}" in matches.columns else "cosine"
    return matches.groupBy("seed").agg(*(F.avg(cos(k)).alias(f"mean_cos_{k}") for k in ks), *(F.avg(f"hit_at_{k}").alias(f"hit_at_{k}") for k in ks))


def permutation_null(words: DataFrame, quota: DataFrame, permutations: int, seed: int, values: list[str]) -> DataFrame:
    """(perm, values...): each permutation draws, of every part of speech, as many words as quota says (all, if there are no more), and takes the mean of each value.

    A word's values do not depend on the permutation, so they are columns of words (word, upos, values), computed once.
    """
    perms = F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm")
    drawn = words.select("word", "upos", *values, perms)
    w = Window.partitionBy("perm", "upos").orderBy(draw(seed, "perm", "word"), "word")
    picked = drawn.withColumn("_n", F.row_number().over(w)).join(quota, "upos").where(F.col("_n") <= F.col("quota"))
    return picked.groupBy("perm").agg(*(F.avg(v).alias(v) for v in values))


def null_summary(null: DataFrame, observed: DataFrame, values: list[str]) -> DataFrame:
    """(metric, observed, null_mean, null_std, z, p_value), a row a value: p_value = (number at or above + 1) / (n + 1); z is infinite where the null does not vary.

    observed has a row with the same columns.
    """
    met = null.crossJoin(F.broadcast(observed.select(*(F.col(v).alias(f"seen_{v}") for v in values))))  # one row
    each = met.select(F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).alias("drawn"), F.col(f"seen_{v}").alias("seen")) for v in values))).alias("x")).select("x.*")
    own = each.groupBy("metric").agg(F.first("seen").alias("observed"), F.avg("drawn").alias("null_mean"), F.stddev_pop("drawn").alias("null_std"), ((F.count_if(F.col("drawn") >= F.col("seen")) + 1) / (F.count("*") + 1)).alias("p_value"))
    z = F.when(F.col("null_std") > 1e-12, (F.col("observed") - F.col("null_mean")) / F.col("null_std")).otherwise(F.lit(float("inf")))
    return own.select("metric", "observed", "null_mean", "null_std", z.alias("z"), "p_value")
