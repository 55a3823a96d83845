"""Registries of feedback parts, and chains of steps after a search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from . import feedback as FB
from . import proximity

#: A step takes a run (topic_id, doc_id, score, rank) and gives one.
PostProcess = Callable[[DataFrame], DataFrame]
#: Ways to choose feedback documents, and to choose terms from them; further ones may be put in by name.
FEEDBACK_SELECTORS: dict[str, Callable[..., DataFrame]] = {"pseudo": FB.pseudo, "judged": FB.judged_first, "mixed": FB.mixed}
TERM_SELECTORS: dict[str, Callable[..., DataFrame]] = {
    "pooled": FB.select_pooled, "rocchio": FB.select_rocchio, "rm3": FB.select_rm3, "divergence": FB.select_divergence, "lca": FB.select_lca, "matf": FB.select_matf,
    "near": proximity.select_near, "cooccurring": proximity.select_cooccurring, "contextual": proximity.select_contextual, "positional": proximity.select_positional,
}


def chain(run: DataFrame, steps: list[PostProcess]) -> DataFrame:
    """The steps, one after the other."""
    return reduce(lambda rows, step: step(rows), steps, run)


def cut(depth: int) -> PostProcess:
    return lambda run: run.where(run["rank"] <= depth)


def without(judged: DataFrame) -> PostProcess:
    return lambda run: FB.residual(run, judged)
