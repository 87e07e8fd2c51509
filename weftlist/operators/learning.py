"""Log-linear training over candidates as DataFrame steps, bilinear scores, and the suffix-count baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlist.operators import paths
from weftlist.operators.ranking import dot

PARAMS = "feature string, weight double, squares double"


def no_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PARAMS)


def expectation_difference(scored: DataFrame, example: list[str]) -> DataFrame:
    """``scored`` (example, score, reward, ...) with q, the softmax weighted by reward less the plain softmax.

    Examples without a rewarded candidate are left out. The maximum and the sums are aggregates joined back, so an
    example's candidates need not meet in one task.
    """
    top = scored.groupBy(*example).agg(F.max("score").alias("top"))
    e = scored.join(top, example).withColumn("e", F.exp(F.col("score") - F.col("top")))
    z = e.groupBy(*example).agg(F.sum("e").alias("all"), F.sum(F.col("e") * F.col("reward")).alias("good")).where("good > 0")
    return e.join(z, example).withColumn("q", F.col("e") * F.col("reward") / F.col("good") - F.col("e") / F.col("all")).drop("top", "e", "all", "good")


def adagrad(params: DataFrame, gradient: DataFrame, rate: float = 0.1, decay: float = 0.01, shrink: float = 0.0, fall: float | None = None, update: int = 1, dual: bool = False) -> DataFrame:
    """One update: L2 ``decay`` on features of the gradient, steps scaled by their summed squares, then soft threshold ``shrink``.

    With ``fall`` the step is ``rate`` / ``update`` ** ``fall`` instead. ``dual`` averaging, which needs steps that don't fall,
    sets a weight to the step times the sum of all its gradients (column ``sums``).
    """
    if dual and fall:
        raise ValueError("dual averaging needs a step that stays or adapts")
    w, s = F.coalesce("weight", F.lit(0.0)), F.coalesce("squares", F.lit(0.0))
    g = F.when(F.col("g").isNull(), 0.0).otherwise(F.col("g") - decay * w)
    g = F.when(F.abs(g) < 1e-6, 0.0).otherwise(g)
    step = F.lit(rate / update**fall) if fall is not None else rate / F.sqrt(s + g * g)
    if dual:
        total = F.coalesce("sums", F.lit(0.0)) + g
        moved = F.when(g == 0, w).otherwise(step * total)
    else:
        moved = w + F.when(g == 0, 0.0).otherwise(step * g)
    shrunk = F.signum(moved) * F.greatest(F.abs(moved) - shrink, F.lit(0.0))
    extra = [total.alias("sums")] if dual else []
    return params.join(gradient, "feature", "full_outer").select("feature", shrunk.alias("weight"), (s + g * g).alias("squares"), *extra)


def train(features: DataFrame, rewards: DataFrame, example: list[str], cand: list[str], iterations: int = 5, batches: int = 1, rate: float = 0.1, decay: float = 0.01, shrink: float = 0.0, folder: str | None = None) -> DataFrame:
    """(feature, weight, squares) after ``iterations`` passes over ``batches`` batches of examples.

    ``features`` are (example, cand, feature, value), ``rewards`` (example, cand, reward). An update takes the summed
    gradient of a batch; with one example for each batch these are the updates of example-wise training. Candidates
    without features score 0. With ``folder``, a path that all executors share, features are written once and params after each update,
    which cuts the lineage; without it params are checkpointed.
    """
    spark = features.sparkSession
    batch = F.pmod(F.xxhash64(*example), F.lit(batches))
    features, rewards = features.withColumn("batch", batch), rewards.withColumn("batch", batch)
    if folder:  # read many times, so made once
        for name, t in (("features", features), ("rewards", rewards)):
            t.write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/{name}")
        features, rewards = (spark.read.schema(t.schema).parquet(f"{folder}/{n}") for n, t in (("features", features), ("rewards", rewards)))
    params = no_params(spark)
    for step in range(iterations * batches):
        own, good = (t.where(F.col("batch") == step % batches).drop("batch") for t in (features, rewards))
        score = good.join(dot(own, params, [*example, *cand]), [*example, *cand], "left").fillna({"score": 0.0})
        q = expectation_difference(score, example).select(*example, *cand, "q")
        gradient = own.join(q, [*example, *cand]).groupBy("feature").agg(F.sum(F.col("q") * F.col("value")).alias("g"))
        params = adagrad(params, gradient, rate, decay, shrink)
        if folder:
            params.write.mode("overwrite").parquet(f"{folder}/params-{step}")
            params = spark.read.schema(PARAMS).parquet(f"{folder}/params-{step}")
        else:
            params = params.checkpoint()
    return params


def prune(params: DataFrame, least: float) -> DataFrame:
    return params.where(F.abs("weight") >= least)


def bilinear(x: Column, matrix: Column, y: Column) -> Column:
    """x' A y for a matrix given as an array of rows; 0 where a vector is null."""
    row = F.transform(matrix, lambda r: F.aggregate(F.zip_with(r, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return F.coalesce(F.aggregate(F.zip_with(x, row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), F.lit(0.0))


def low_rank(x: Column, y: Column, u: Column, v: Column) -> Column:
    """The sum over ranks of (u_i . x)(v_i . y); 0 where a vector is null."""

    def products(rows: Column, z: Column) -> Column:
        return F.transform(rows, lambda r: F.aggregate(F.zip_with(r, z, lambda a, b: a * b), F.lit(0.0), lambda s, w: s + w))

    return F.coalesce(F.aggregate(F.zip_with(products(u, x), products(v, y), lambda a, b: a * b), F.lit(0.0), lambda s, w: s + w), F.lit(0.0))


def vector_gradient(pairs: DataFrame) -> DataFrame:
    """(i, j, g): the sum of q x_i y_j over rows (q, x, y), pre-aggregated in every task; rows with a null vector give nothing."""
    rows = pairs.where("x is not null and y is not null").select("q", F.posexplode("x").alias("i", "a"), "y").select("q", "i", "a", F.posexplode("y").alias("j", "b"))
    return rows.groupBy("i", "j").agg(F.sum(F.col("q") * F.col("a") * F.col("b")).alias("g"))


def matrix_update(matrix: DataFrame, gradient: DataFrame, **how) -> DataFrame:
    """An update, as ``adagrad``, of a matrix (i, j, weight, squares) of which each entry is a feature."""
    name = F.concat_ws(",", F.col("i").cast("string"), F.col("j").cast("string")).alias("feature")
    extra = [c for c in ("sums",) if c in matrix.columns]
    out = adagrad(matrix.select(name, "weight", "squares", *extra), gradient.select(name, "g"), **how)
    at = F.split("feature", ",")
    return out.select(F.get(at, F.lit(0)).cast("int").alias("i"), F.get(at, F.lit(1)).cast("int").alias("j"), *[c for c in out.columns if c != "feature"])


def low_rank_gradient(pairs: DataFrame, factors: DataFrame) -> DataFrame:
    """(side, r, i, g): gradients of the sum over ranks of (u_r . x)(v_r . y), rows (q, x, y), factors (r, u, v): q (v_r . y) x for u and q (u_r . x) y for v."""
    inner = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    rows = pairs.where("x is not null and y is not null").crossJoin(F.broadcast(factors))  # as many factors as the rank, a parameter
    sides = F.array(F.struct(F.lit("u").alias("side"), (F.col("q") * inner("v", "y")).alias("k"), F.col("x").alias("z")), F.struct(F.lit("v").alias("side"), (F.col("q") * inner("u", "x")).alias("k"), F.col("y").alias("z")))
    each = rows.select("r", F.inline(sides)).select("side", "r", "k", F.posexplode("z").alias("i", "z"))
    return each.groupBy("side", "r", "i").agg(F.sum(F.col("k") * F.col("z")).alias("g"))


def explained(features: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, contribution, value, weight) of features that aren't 0; repeats are added up first."""
    f = features.groupBy(*keys, "feature").agg(F.sum("value").alias("value")).where("value <> 0")
    f = f.join(params.select("feature", "weight"), "feature", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return f.select(*keys, "feature", (F.col("value") * F.col("weight")).alias("contribution"), "value", "weight")


def difference(good: DataFrame, predicted: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """As ``explained`` for the features of one candidate less those of another."""
    return explained(good.select(*keys, "feature", "value").unionByName(predicted.select(*keys, "feature", (-F.col("value")).alias("value"))), params, keys)


def of_domain(feature: Column, domain: str, allow: bool = True) -> Column:
    """Whether a feature is of the domain, or of another; basic ones always pass."""
    hit = F.startswith(feature, F.lit(f"{domain} :: "))
    return F.startswith(feature, F.lit("basic :: ")) | (hit if allow else ~hit)


def matching(feature: Column, exact: str | None = None, pattern: str | None = None, inverse: bool = False) -> Column:
    """Whether a feature is the one named and its whole matches the pattern, or with ``inverse`` doesn't; conditions left out hold."""
    out = F.lit(True) if exact is None else feature == exact
    if pattern is not None:
        hit = feature.rlike(f"^(?:{pattern})$")
        out = out & (~hit if inverse else hit)
    return out


def path_suffix(xpath: Column, length: int = 5, ordered: bool = False, indices: str = "none") -> Column:
    """The last steps of a path, by default as a sorted bag; indices left out, as [*] (``star``), or as they are (``full``)."""
    to = {"none": lambda s: F.regexp_replace(s, r"\[.*", ""), "star": lambda s: F.regexp_replace(s, r"\[.*", "[*]"), "full": lambda s: s}[indices]
    steps = F.transform(paths.suffix(xpath, length), to)
    return F.array_join(steps if ordered else F.array_sort(steps), "/")


def suffix_counts(cands: DataFrame, most: int = 10_000, length: int = 5, ordered: bool = False, indices: str = "none") -> DataFrame:
    """(suffix, n) of rewarded candidates (xpath, reward), the ``most`` frequent ones: the baseline's model."""
    return cands.where("reward > 0").groupBy(path_suffix(F.col("xpath"), length, ordered, indices).alias("suffix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(most)


def baseline_score(cands: DataFrame, counts: DataFrame, length: int = 5, ordered: bool = False, indices: str = "none") -> DataFrame:
    """``cands`` with the count of their suffix as score, 0 for an unseen one."""
    return cands.withColumn("suffix", path_suffix(F.col("xpath"), length, ordered, indices)).join(counts, "suffix", "left").withColumn("score", F.coalesce("n", F.lit(0)).cast("double")).drop("suffix", "n")


def combined(candidate: DataFrame, group: DataFrame, of: DataFrame, keys: list[str], group_keys: list[str]) -> DataFrame:
    """Features of candidates with those of their groups, from ``of`` (keys, group_keys)."""
    return candidate.select(*keys, "feature", "value").unionByName(of.select(*keys, *[k for k in group_keys if k not in keys]).join(group, group_keys).select(*keys, "feature", "value"))


def total_score(features: DataFrame, params: DataFrame, keys: list[str], pairs: DataFrame | None = None, matrix: Column | None = None) -> DataFrame:
    """(keys, score): the features' weights and, for rows (keys, x, y) of ``pairs``, x' A y."""
    out = dot(features, params, keys)
    if pairs is None:
        return out
    more = pairs.select(*keys, bilinear(F.col("x"), matrix, F.col("y")).alias("more"))
    return out.join(more, keys, "left").select(*keys, (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def train_folds(features: DataFrame, rewards: DataFrame, example: list[str], cand: list[str], folds: int, split: Column, **how) -> DataFrame:
    """(fold, feature, weight, squares): a model for each fold, trained on the examples whose ``split`` is not the fold's number."""
    out = None
    folder = how.pop("folder", None)
    for fold in range(folds):
        own = (t.where(split != fold) for t in (features, rewards))
        model = train(*own, example, cand, folder=f"{folder}/fold-{fold}" if folder else None, **how).withColumn("fold", F.lit(fold))
        out = model if out is None else out.unionByName(model)
    return out
