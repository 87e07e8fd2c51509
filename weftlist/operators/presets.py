"""Feature domains by name, presets of them, and learners with one interface."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlist.operators import candidates, features, learning, lexical, ranking
from weftlist.operators.features import KEYS

GroupFeatures = Callable[[DataFrame, DataFrame], DataFrame]  # (nodes, groups) -> (keys, feature, value)
Enumeration = Callable[[DataFrame], DataFrame]  # nodes -> (page_id, root_no, xpath, node_ids, entities)

DOMAINS: dict[str, GroupFeatures] = {
    "self-or-ancestors": features.self_or_ancestors,
    "node-range": features.node_range,
    "hole": features.hole,
    "entity": lambda nodes, groups: features.entity(groups),
    "ling": lambda nodes, groups: lexical.linguistic(groups),
    "token-freq": lambda nodes, groups: lexical.token_freq(groups),
}
PRESETS: dict[str, tuple[str, ...]] = {
    "default": ("self-or-ancestors", "node-range", "hole", "entity", "ling"),
    "structural": ("self-or-ancestors", "node-range", "hole"),
    "denotation": ("entity", "ling"),
    "none": (),
}


def extract(nodes: DataFrame, groups: DataFrame, preset: str | Iterable[str] = "default", extra: dict[str, GroupFeatures] | None = None) -> DataFrame:
    """(keys, feature, value) of every group: ``basic :: bias`` and the features of the preset's or listed domains; ``extra`` adds domains."""
    known = {**DOMAINS, **(extra or {})}
    names = PRESETS[preset] if isinstance(preset, str) else tuple(preset)
    unknown = set(names) - set(known)
    if unknown:
        raise ValueError(f"no such domains: {sorted(unknown)}")
    out = groups.select(*KEYS, F.lit("basic :: bias").alias("feature"), F.lit(1.0).alias("value"))
    for name in (*names, *(extra or {})):
        out = out.unionByName(known[name](nodes, groups).select(*KEYS, "feature", "value"))
    return features.bag(out, KEYS)


class Learner(Protocol):
    def fit(self, cands: DataFrame, feats: DataFrame | None = None) -> DataFrame: ...

    def score(self, cands: DataFrame, model: DataFrame, feats: DataFrame | None = None) -> DataFrame: ...


@dataclass
class LogLinear:
    """Log-linear over features of (example, cand): ``cands`` have a reward when it is fitted."""

    example: list[str]
    cand: list[str]
    options: dict = field(default_factory=dict)
    least_examples: int = 2
    least_weight: float = 0.0

    def fit(self, cands: DataFrame, feats: DataFrame | None = None) -> DataFrame:
        kept = features.common(feats, self.example, self.least_examples)
        params = learning.train(kept, cands.select(*self.example, *self.cand, "reward"), self.example, self.cand, **self.options)
        return learning.prune(params, self.least_weight) if self.least_weight else params

    def score(self, cands: DataFrame, model: DataFrame, feats: DataFrame | None = None) -> DataFrame:
        keys = [*self.example, *self.cand]
        return cands.join(ranking.dot(feats, model, keys), keys, "left").fillna({"score": 0.0})


@dataclass
class SuffixBaseline:
    """Counts of path suffixes among rewarded candidates."""

    length: int = 5
    ordered: bool = False
    indices: str = "none"
    most: int = 10_000

    def fit(self, cands: DataFrame, feats: DataFrame | None = None) -> DataFrame:
        return learning.suffix_counts(cands, self.most, self.length, self.ordered, self.indices)

    def score(self, cands: DataFrame, model: DataFrame, feats: DataFrame | None = None) -> DataFrame:
        return learning.baseline_score(cands, model, self.length, self.ordered, self.indices)


def answers(examples: DataFrame, scored: DataFrame, example: list[str], ties: list[str], keep: Column | None = None) -> DataFrame:
    """``examples`` with their first candidate by score, null where there is none; ``keep`` filters candidates first."""
    pool = scored if keep is None else scored.where(keep)
    first = ranking.ranked(pool, example, "score", ties, "entities").where("rank = 1")
    return examples.join(first, example, "left")


def beam(scored: DataFrame, example: list[str], ties: list[str], size: int = 500) -> DataFrame:
    """The ``size`` best candidates of each example."""
    return ranking.ranked(scored, example, "score", ties, "entities").where(F.col("rank") <= size)


def lists(nodes: DataFrame, enumerate_paths: Enumeration = candidates.candidates, level: int = 3) -> DataFrame:
    """Groups of the lists that an enumeration finds, normalised as they are shown."""
    return candidates.groups(enumerate_paths(nodes), level)
