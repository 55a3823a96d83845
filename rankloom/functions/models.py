"""Weighting models as Column expressions over (tf, dl, df, ctf, qtf, ql, N, T, avdl, atf).

``log2`` of a value that isn't positive counts as 0.  ``unseen`` is a term's share of the score of a document
that lacks it; None stands for 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG2_E, TWO_PI = 1.4426950408889634, 6.283185307179586


def lg(x: Column) -> Column:
    return F.when(x > 0, F.log2(x)).otherwise(F.lit(0.0))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(F.lit(0.0))


def nf2(s, c: float = 1.0) -> Column:
    return s.tf * lg(1 + c * s.avdl / s.dl)


def idf_bm(s) -> Column:
    return lg((s.N - s.df + 0.5) / (s.df + 0.5))


def k3(s, k: float) -> Column:
    return (k + 1) * s.qtf / (k + s.qtf)


def squash(x: Column) -> Column:
    return x / (1 + x)


def bm25(s, k1=1.2, k=8.0, b=0.35) -> Column:
    return (k1 + 1) * s.tf / (k1 * (1 - b + b * s.dl / s.avdl) + s.tf) * k3(s, k) * idf_bm(s)


def abm25(s, k1=1.2, k=8.0, b=0.35) -> Column:
    adapted = F.when(s.ql == 1, 0.85 * b).when(s.ql == 2, 0.95 * b).when(s.ql == 3, b).when(s.ql == 4, 1.1 * b).otherwise(1.15 * b)
    return (k1 + 1) * s.tf / (k1 * (1 - adapted + adapted * s.dl / s.avdl) + s.tf) * k3(s, k) * idf_bm(s)


def lbm25(s, k1=1.2, k=8.0, b=0.35, sigma=0.5) -> Column:
    level = s.tf / (1 - b + b * s.dl / s.avdl)
    return (k1 + 1) * (level + sigma) / (k1 + level + sigma) * k3(s, k) * idf_bm(s)


def dfr_bm25(s, c=1.0, k1=1.2, k=1000.0) -> Column:
    x = nf2(s, c)
    return k3(s, k) * x / (x + k1) * idf_bm(s)


def tf_idf(s, k1=1.2, b=0.75) -> Column:
    return s.qtf * k1 * s.tf / (s.tf + k1 * (1 - b + b * s.dl / s.avdl)) * lg(s.N / s.df + 1)


def lemur_tf_idf(s, k1=1.2, b=0.75) -> Column:
    return s.qtf * k1 * s.tf / (s.tf + k1 * (1 - b + b * s.dl / s.avdl)) * lg(s.N / s.df) * lg(s.N / s.df)


def pl2(s, c=1.0) -> Column:
    f, x = s.ctf / s.N, nf2(s, c)
    return s.qtf / (x + 1) * (x * lg(1 / f) + f * LOG2_E + 0.5 * lg(TWO_PI * x) + x * (lg(x) - LOG2_E))


def stirling(n: Column, m: Column) -> Column:
    return (m + 0.5) * lg(n / m) + (n - m) * lg(n)


def bb2(s, c=1.0) -> Column:
    x = nf2(s, c)
    return (s.ctf + 1) / (s.df * (x + 1)) * s.qtf * (-lg(s.N - 1) - LOG2_E + stirling(s.N + s.ctf - 1, s.N + s.ctf - x - 2) - stirling(s.ctf, s.ctf - x))


def ifb2(s, c=1.0) -> Column:
    x = nf2(s, c)
    return x * s.qtf * lg((s.N + 1) / (s.ctf + 0.5)) * (s.ctf + 1) / (s.df * (x + 1))


def inl2(s, c=1.0) -> Column:
    x = nf2(s, c)
    return x * lg((s.N + 1) / (s.df + 0.5)) * s.qtf / (x + 1)


def in_exp(s, x: Column) -> Column:
    expected = s.N * (1 - F.exp(-s.ctf / s.N))
    return x * lg((s.N + 1) / (expected + 0.5)) * s.qtf * (s.ctf + 1) / (s.df * (x + 1))


def in_expb2(s, c=1.0) -> Column:
    return in_exp(s, nf2(s, c))


def in_expc2(s, c=1.0) -> Column:
    return in_exp(s, s.tf * ln(1 + c * s.avdl / s.dl))


def dlh(s, k=0.5) -> Column:
    f = s.tf / s.dl
    return s.qtf * (s.tf * lg(s.tf * s.avdl / s.dl * s.N / s.ctf) + (s.dl - s.tf) * lg(1 - f) + 0.5 * lg(TWO_PI * s.tf * (1 - f))) / (s.tf + k)


def dlh13(s, k=0.5) -> Column:
    f = s.tf / s.dl
    return s.qtf * (s.tf * lg(s.tf * s.avdl / s.dl * s.N / s.ctf) + 0.5 * lg(TWO_PI * s.tf * (1 - f))) / (s.tf + k)


def dph(s) -> Column:
    f = s.tf / s.dl
    return s.qtf * (1 - f) * (1 - f) / (s.tf + 1) * (s.tf * lg(s.tf * s.avdl / s.dl * s.N / s.ctf) + 0.5 * lg(TWO_PI * s.tf * (1 - f)))


def dfree(s) -> Column:
    p, q, inverse = s.tf / s.dl, (s.tf + 1) / (s.dl + 1), s.T / s.ctf
    return s.qtf * s.tf * lg(q / p) * (-s.tf * lg(p * inverse) + (s.tf + 1) * lg(q * inverse) + 0.5 * lg(q / p))


def dirichlet_ln(s, mu=1000.0) -> Column:
    return s.qtf * ln((s.tf + mu * s.ctf / s.T) / (s.dl + mu))


def dlm(s, mu=1000.0) -> Column:
    return s.qtf * lg((s.tf + mu * s.ctf / s.T) / (s.dl + mu))


def jelinek_mercer(s, weight=0.15) -> Column:
    return s.qtf * lg((1 - weight) * s.tf / s.dl + weight * s.ctf / s.T)


def hiemstra(s, c=0.15) -> Column:
    return s.qtf * lg(1 + (1 - c) * s.tf * s.T / (c * s.ctf * s.dl)) + s.qtf * lg(c * s.ctf / s.T)


def burst(s) -> Column:
    return lg(1 + s.tf) / lg(1 + s.atf)


def length_part(s) -> Column:
    return s.tf * lg(1 + s.avdl / s.dl)


def matf(s) -> Column:
    mixed = 2 / (1 + lg(1 + s.ql))
    return s.qtf * (mixed * squash(burst(s)) + (1 - mixed) * squash(length_part(s))) * lg((s.N + 1) / s.df) * squash(s.ctf / s.df)


def ematf(s) -> Column:
    mixed = 2 / (1 + lg(1 + s.ql))
    level = lg((s.N + 1) / s.df) * burst(s) / s.norm * s.dl / s.atf
    return s.qtf * (mixed * squash(level) + (1 - mixed) * squash(length_part(s))) * idf_bm(s)


def tfmidf(s, weight=0.9) -> Column:
    mixed = 2 / (1 + lg(1 + s.ql))
    idf = lg((s.N + 1) / s.df)
    return s.qtf * (weight * (mixed * squash(burst(s)) + (1 - mixed) * squash(length_part(s))) + (1 - weight) * squash(idf))


def edlm(s, mu=1000.0, alpha=0.0) -> Column:
    return s.qtf * lg((s.tf + mu * s.ctf / s.T) * (1 - alpha + alpha * squash(burst(s))) / (s.dl + mu))


def tsdlm(s, mu=1000.0, weight=0.9) -> Column:
    """``s.critf``: the collection's sum of squashed burst values of the term."""
    return s.qtf * lg(s.ctf * (weight * s.tf / s.ctf + (1 - weight) * squash(burst(s)) / s.critf + mu / s.T) / (s.dl + mu))


@dataclass(frozen=True)
class Model:
    score: Callable[..., Column]
    unseen: Callable[..., Column] | None = None


def _absent(model: Callable[..., Column]) -> Callable[..., Column]:
    """The model's value at tf = 0."""
    return lambda s, **p: model(SimpleNamespace(**(vars(s) | {"tf": F.lit(0.0)})), **p)


ZERO = {"BM25": bm25, "ABM25": abm25, "LBM25": lbm25, "DFR_BM25": dfr_bm25, "TF_IDF": tf_idf, "LemurTF_IDF": lemur_tf_idf, "PL2": pl2, "IFB2": ifb2, "InL2": inl2, "In_expB2": in_expb2, "In_expC2": in_expc2,
        "DLH": dlh, "DLH13": dlh13, "DPH": dph, "DFRee": dfree, "MATF": matf, "EMATF": ematf, "TFMIDF": tfmidf}
SMOOTHED = {"BB2": bb2, "Dirichlet_LM": dirichlet_ln, "DLM": dlm, "JelinekMercer_LM": jelinek_mercer, "Hiemstra_LM": hiemstra, "EDLM": edlm, "TSDLM": tsdlm}
#: Further models may be put in here by name.
MODELS: dict[str, Model] = {k: Model(f) for k, f in ZERO.items()} | {k: Model(f, _absent(f)) for k, f in SMOOTHED.items()}


def bm25_ratio(s, k1=1.2, b=0.75) -> Column:
    """tf over its pivoted length, saturated, times the natural-log idf."""
    x = s.tf / (1 - b + b * s.dl / s.avdl)
    return s.qtf * x / (x + k1) * ln((s.N - s.df + 0.5) / (s.df + 0.5))


MODELS["BM25_ratio"] = Model(bm25_ratio)
