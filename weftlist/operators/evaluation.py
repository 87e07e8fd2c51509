"""Matching of predicted lists with gold lists, rewards, cases and summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from weftlist.functions import text
from weftlist.operators.ranking import ir


def matches(gold: Column, predicted: Column, kind: str = "near") -> Column:
    """Whether one gold string fits one predicted string: exact, substring (of the prediction) or near (edit distance up to 2). Null never fits."""
    if kind == "exact":
        hit = gold == predicted
    elif kind == "substring":
        hit = F.contains(predicted, gold)
    else:
        hit = (gold == predicted) | text.near(gold, predicted, 2)
    return F.coalesce(hit, F.lit(False))


@F.pandas_udf(IntegerType())
def _matching(edges: pd.Series) -> pd.Series:
    """Size of a largest one-to-one matching: no built-in function searches augmenting paths."""

    def size(rows) -> int:
        owner: dict[int, int] = {}
        found = 0
        for start in range(len(rows)):
            came, queue, end = {}, [start], None
            for left in queue:
                for right in rows[left]:
                    if right not in came:
                        came[right] = left
                        if right not in owner:
                            end = right
                            break
                        queue.append(owner[right])
                if end is not None:
                    break
            while end is not None:  # hand the path's right ends on to its left ends
                left = came[end]
                previous = next((r for r, o in owner.items() if o == left and r != end), None)
                owner[end] = left
                end = previous if left != start else None
            found = len(owner)
        return found

    return edges.map(lambda rows: 0 if rows is None else size(rows))


def near_pairs(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(gold, predicted) of two tables of strings (value) that fit nearly, each pair once: strings meet by what is left of both after up to two deletions."""
    sides = [t.select(F.col("value").alias(n)).where("value is not null").distinct().select(n, F.explode(text.deletions(F.col(n))).alias("rest")) for t, n in ((gold, "gold"), (predicted, "predicted"))]
    met = sides[0].join(sides[1], "rest").select("gold", "predicted").distinct()
    return met.where(matches(F.col("gold"), F.col("predicted")))


def n_equal(gold: Column, predicted: Column) -> Column:
    """The most gold strings that can be given an equal predicted string each."""
    return F.aggregate(F.array_distinct(gold), F.lit(0), lambda n, v: n + F.least(F.size(F.filter(gold, lambda x: x == v)), F.size(F.filter(predicted, lambda x: x == v))))


def edges(gold: Column, predicted: Column, kind: str = "near") -> Column:
    """For each gold string the places of the predicted strings that it fits."""
    numbered = F.transform(predicted, lambda p, j: F.struct(p.alias("p"), j.alias("j")))
    return F.transform(gold, lambda g: F.transform(F.filter(numbered, lambda x: matches(g, x.p, kind)), lambda x: x.j))


def scored(df: DataFrame, gold: str, predicted: str, kind: str = "near") -> DataFrame:
    """``df`` with correct, precision, recall, f1 and exact (equally long and matched throughout); 0 without any fit."""
    if kind == "exact":
        out = df.withColumn("correct", n_equal(F.col(gold), F.col(predicted)))
    else:
        # A generator over one element keeps the optimizer from copying the lambdas into each use of the matching.
        out = df.select("*", F.explode(F.array(edges(F.col(gold), F.col(predicted), kind))).alias("_edges")).withColumn("correct", _matching("_edges")).drop("_edges")
    p, r, f1 = ir(F.col("correct"), F.size(predicted), F.size(gold))
    exact = (F.size(gold) == F.size(predicted)) & (F.col("correct") == F.size(gold))
    return out.withColumns({"precision": p, "recall": r, "f1": f1, "exact": exact})


def general_web(first: Column, second: Column, last: Column, entities: Column) -> Column:
    """How many of the criteria first, second and last element hold."""
    parts = [matches(first, F.get(entities, F.lit(0))), matches(second, F.get(entities, F.lit(1))), matches(last, F.when(F.size(entities) > 0, F.element_at(entities, -1)))]
    return parts[0].cast("int") + parts[1].cast("int") + parts[2].cast("int")


def person_forms(first: Column, middle: Column, last: Column) -> Column:
    """The ways to write a person's name, with initials and last name first; a middle name of one letter is an initial."""
    f, m = F.concat(F.substring(first, 1, 1), F.lit(".")), F.concat(F.substring(middle, 1, 1), F.lit("."))
    short = F.char_length(F.regexp_replace(middle, r"^(.)\.$", "$1")) <= 1
    join = lambda *parts: F.concat_ws(" ", *parts)
    behind = lambda *parts: F.concat(last, F.lit(", "), join(*parts))
    plain = F.array(join(first, last), behind(first), join(f, last), behind(f))
    full = F.when(short, F.array().cast("array<string>")).otherwise(F.array(join(first, middle, last), behind(first, middle)))
    return F.when(middle.isNull(), plain).otherwise(F.concat(plain, full, F.array(join(first, m, last), behind(first, m))))


def matches_person(forms: Column, predicted: Column) -> Column:
    return F.coalesce(F.array_contains(forms, predicted), F.lit(False))


def raw_reward(correct: Column, gold: Column, slack: float = 0.8) -> Column:
    """1 if at most ``slack`` gold strings are missed."""
    return (correct >= gold - slack).cast("double")


def rewarded(df: DataFrame, gold: str, predicted: str, zero_one: bool = True, fuzzy: bool = True, criterion: str = "recall", threshold: float = 0.8, generous: bool = False) -> DataFrame:
    """``df`` with correct, precision, recall, f1, exact and reward, by the kind of answer.

    With ``zero_one`` rows marked ``detailed`` need their ``first``, ``second`` and ``last`` string, the others all of ``gold``
    and nothing else; without it the reward is the ``criterion`` (precision, recall, f1 or raw) from ``threshold`` on. Strings
    match by edit distance if ``fuzzy``, else as substrings.
    """
    kind = "near" if fuzzy else "substring"
    out = scored(df, gold, predicted, kind)
    if not zero_one:
        reward = raw_reward(F.col("correct"), F.size(gold), threshold) if criterion == "raw" else injective_reward(F.col(criterion), threshold)
        return out.withColumn("reward", reward)
    hit = general_web(F.col("first"), F.col("second"), F.col("last"), F.col(predicted))
    out = out.withColumn("reward", criteria_reward(F.col("exact"), F.col("f1"), generous))
    detailed = F.coalesce(F.col("detailed"), F.lit(False))
    share = hit / 3.0
    web = F.when(share > 0.8, share).otherwise(0.0) if generous else (hit == 3).cast("double")
    return out.withColumns({"reward": F.when(detailed, web).otherwise(F.col("reward")), "correct": F.when(detailed, hit).otherwise(F.col("correct")), **{c: F.when(detailed, share).otherwise(F.col(c)) for c in ("precision", "recall", "f1")}, "exact": F.when(detailed, hit == 3).otherwise(F.col("exact"))})


def against_best(ranked: DataFrame, example: list[str], entities: str) -> DataFrame:
    """(example, f1_on_best, true_f1_on_best): the first and the first rewarded candidate against the best one's strings, matched nearly; null without a best."""
    r = ranked.select(*example, "rank", "reward", F.col(entities).alias("e"))
    best = r.where("reward > 0").groupBy(*example).agg(F.min_by("e", F.struct(-F.col("reward"), F.col("rank"))).alias("gold"), F.min_by("e", "rank").alias("true"))
    top = r.where("rank = 1").select(*example, F.col("e").alias("top")).join(best, example, "left")
    first = scored(top.where("gold is not null"), "gold", "top").select(*example, F.col("f1").alias("f1_on_best"), "gold", "true")
    both = scored(first, "gold", "true").select(*example, "f1_on_best", F.col("f1").alias("true_f1_on_best"))
    return top.select(*example).join(both, example, "left")


def distinct_rewards(df: DataFrame, gold: str, predicted: str, key: list[str], **how) -> DataFrame:
    """As ``rewarded``, each different list of an example matched once."""
    gold_of = [c for c in (gold, "first", "second", "last", "detailed") if c in df.columns]
    each = rewarded(df.select(*key, predicted, *gold_of).dropDuplicates([*key, predicted]), gold, predicted, **how)
    return df.join(each.drop(*gold_of), [*key, predicted])


def containing(ranked: DataFrame, seed: str, entities: str, kind: str = "near") -> DataFrame:
    """Candidates with a string that fits the seed, itself a column."""
    return ranked.where(F.exists(entities, lambda e: matches(F.col(seed), e, kind)))


def learning_curve(iterations: list[tuple[DataFrame, DataFrame]], f1: str = "mean_f1") -> DataFrame:
    """(iteration, train_accuracy, train_oracle, train_f1, test_..) of the summaries after each pass."""
    rows = None
    for i, pair in enumerate(iterations):
        sides = [s.select(F.col("accuracy").alias(f"{n}_accuracy"), F.col("oracle").alias(f"{n}_oracle"), F.col(f1).alias(f"{n}_f1")) for n, s in zip(("train", "test"), pair)]
        row = sides[0].join(sides[1]).select(F.lit(i + 1).alias("iteration"), "*")  # two tables of one row
        rows = row if rows is None else rows.unionByName(row)
    return rows


def outputs(summaries: DataFrame, prefix: str) -> DataFrame:
    """(prefix, key, value) of a one-row summary."""
    names = [c for c, t in summaries.dtypes if t in ("double", "bigint", "int")]
    return summaries.select(F.lit(prefix).alias("prefix"), F.inline(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names])))


def criteria_reward(exact: Column, f1: Column, generous: bool = False) -> Column:
    """1 where all criteria hold; a generous one is the F1 above 0.8."""
    return F.when(f1 > 0.8, f1).otherwise(0.0) if generous else exact.cast("double")


def injective_reward(score: Column, threshold: float = 0.8) -> Column:
    """A precision, recall or F1, or 0 under the threshold."""
    return F.when(score < threshold, 0.0).otherwise(score)


def cases(ranked: DataFrame, example: list[str]) -> DataFrame:
    """One row for each example of (rank, unique_rank, reward, f1): its case, first rewarded unique rank and best candidate.

    The best is the candidate of highest positive reward, of the first rank on ties.
    """
    good = F.col("reward") > 0
    out = ranked.groupBy(*example).agg(
        F.min(F.when(good, F.col("rank"))).alias("true_rank"), F.min(F.when(good, F.col("unique_rank"))).alias("true_unique_rank"),
        F.min(F.when(good, F.struct(-F.col("reward"), "rank"))).getField("rank").alias("best_rank"), F.max(F.when(F.col("rank") == 1, F.col("f1"))).alias("f1"),
    )
    return out.withColumn("case", F.when(F.col("true_rank").isNull(), "super-fail").when(F.col("true_rank") > 1, "normal-fail").otherwise("success"))


def summary(case_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy against all examples and against those with a rewarded candidate, oracle and mean F1."""
    success, found = F.count_if(F.col("case") == "success"), F.count_if(F.col("case") != "super-fail")
    return case_rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), (success / F.count("*")).alias("accuracy"), F.try_divide(success, found).alias("accuracy_found"), (found / F.count("*")).alias("oracle"), F.avg("f1").alias("mean_f1"))


def over_folds(summaries: DataFrame, names: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over folds."""
    return summaries.agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("sd", F.stddev_pop))])
