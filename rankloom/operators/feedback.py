"""Feedback: choosing documents, weighing their terms, mixing them into the query, and re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import lg, squash
from ..sources.storage import kept
from .index import Index, bounded
from .search import range_ranks


def pseudo(run: DataFrame, n: int) -> DataFrame:
    """The first n documents of each topic: (topic_id, doc_id, rank, score)."""
    return run.where(F.col("rank") <= n).select("topic_id", "doc_id", "rank", "score")


def judged_first(run: DataFrame, qrels: DataFrame, n: int) -> DataFrame:
    """Known relevant documents in the run's order, n at most; topics without any fall back to the first n."""
    known = run.join(qrels.where("grade <> 0").select("topic_id", "doc_id"), ["topic_id", "doc_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy("rank"))
    chosen = known.withColumn("rank", place).where(F.col("rank") <= n).select("topic_id", "doc_id", "rank", "score")
    others = pseudo(run, n).join(chosen.select("topic_id").distinct(), "topic_id", "left_anti")
    return chosen.unionByName(others)


def mixed(run: DataFrame, qrels: DataFrame, n: int, gamma: float = 0.5) -> DataFrame:
    """Judged documents with weight 1 and the first n others with weight ``gamma``."""
    known = qrels.where("grade <> 0").select("topic_id", "doc_id")
    a = run.join(known, ["topic_id", "doc_id"], "left_semi").select("topic_id", "doc_id", "rank", "score", F.lit(1.0).alias("weight"))
    b = pseudo(run, n).join(known, ["topic_id", "doc_id"], "left_anti").withColumn("weight", F.lit(gamma))
    return a.unionByName(b)


def before(run: DataFrame, times: DataFrame, topic_times: DataFrame) -> DataFrame:
    """Only documents no later than their topic: times (doc_id, ts), topic_times (topic_id, ts)."""
    return run.join(times.withColumnRenamed("ts", "doc_ts"), "doc_id").join(F.broadcast(topic_times), "topic_id").where("doc_ts <= ts").drop("doc_ts", "ts")


def pooled(feedback: DataFrame, index: Index) -> DataFrame:
    """(topic_id, term, fb_tf, fb_df, fb_len, df, ctf, N, T, avdl) over each topic's documents."""
    rows = kept(index.postings.select("term", "doc_id", "tf", "dl").join(bounded(feedback.select("topic_id", "doc_id")), "doc_id"), "feedback")  # one scan of the postings
    lengths = rows.groupBy("topic_id", "doc_id").agg(F.first("dl").alias("dl")).groupBy("topic_id").agg(F.sum("dl").alias("fb_len"))
    terms = rows.groupBy("topic_id", "term").agg(F.sum("tf").alias("fb_tf"), F.count("*").alias("fb_df"))
    return terms.join(F.broadcast(lengths), "topic_id").join(index.lexicon, "term").crossJoin(F.broadcast(index.stats))


def bo1() -> Column:
    f = F.col("ctf") / F.col("N")
    return F.col("fb_tf") * lg((1 + f) / f) + lg(1 + f)


def bo2() -> Column:
    f = F.col("ctf") * F.col("fb_len") / F.col("T")
    return F.col("fb_tf") * lg((1 + f) / f) + lg(1 + f)


def kl_plain() -> Column:
    p, c = F.col("fb_tf") / F.col("fb_len"), F.col("ctf") / F.col("T")
    return F.when(p < c, 0.0).otherwise(p * lg(p / c))


def kl() -> Column:
    """With the extra factor for bursts."""
    burst = lg(1 + F.col("fb_tf")) / lg(1 + F.col("fb_tf") / F.col("fb_df"))
    return squash(burst) * kl_plain()


def tfidf() -> Column:
    return F.col("fb_tf") * lg(F.col("N") / F.col("df"))


def lemur_tfidf(k1: float = 1.2, b: float = 0.75) -> Column:
    tf = F.col("fb_tf")
    return k1 * tf / (tf + k1 * (1 - b + b * F.col("fb_len") / F.col("avdl"))) * lg(F.col("N") / F.col("df"))


def model_based(weight: float = 0.5) -> Column:
    value = (F.col("fb_tf") / F.col("fb_len") - weight * F.col("ctf") / F.col("T")) / (1 - weight)
    return F.when(value <= 0.001, 0.0).otherwise(value)


def matf() -> Column:
    """Bursts against the pool's mean term frequency, and length-adjusted frequency, mixed by the query's length."""
    tf, aef = F.col("fb_tf"), F.col("ctf") / F.col("df")
    mixed = 2 / (1 + lg(1 + F.col("ql")))
    burst = lg(1 + tf) / lg(1 + F.col("fb_len") / F.col("fb_terms"))
    level = tf * lg(1 + F.col("avdl") / F.col("fb_len"))
    return (mixed * squash(burst) + (1 - mixed) * squash(level)) * lg((F.col("N") + 1) / F.col("df")) * squash(aef)


def select_matf(feedback: DataFrame, index: Index, query: DataFrame, k: int = 40, min_docs: int = 2, by: str = "max") -> DataFrame:
    """The terms of all feedback documents together by ``matf``."""
    rows = pooled(feedback, index)
    distinct = rows.groupBy("topic_id").agg(F.count("*").alias("fb_terms"))
    lengths = query.groupBy("topic_id").agg(F.first("ql").alias("ql"))
    weighed = rows.join(F.broadcast(distinct), "topic_id").join(F.broadcast(lengths), "topic_id").where(F.col("fb_df") >= min_docs)  # one row for each topic
    return best_terms(weighed.select("topic_id", "term", matf().alias("weight")), k, by)


QE_MODELS = {"Bo1": bo1, "Bo2": bo2, "KL": kl, "KL_plain": kl_plain, "TFIDF": tfidf, "Lemur_TFIDF": lemur_tfidf, "ModelBased": model_based}


def best_terms(weights: DataFrame, k: int, by: str = "max") -> DataFrame:
    """The k heaviest terms of each topic, divided by the largest weight or the sum.

    Weights that differ by less than a billionth of the topic's largest are equal (sums come in any order); ties go by term.
    """
    topic = Window.partitionBy("topic_id")
    top = F.max("weight").over(topic)
    rounded = weights.withColumn("level", F.round(F.when(top > 0, F.col("weight") / top).otherwise(F.col("weight")), 9))
    ranked = rounded.withColumn("place", F.row_number().over(topic.orderBy(F.desc("level"), "term"))).where(F.col("place") <= k)
    total = (F.max if by == "max" else F.sum)("weight").over(topic)
    return ranked.select("topic_id", "term", F.when(total > 0, F.col("weight") / total).otherwise(0.0).alias("weight"))


def select_pooled(feedback: DataFrame, index: Index, model: str = "Bo1", k: int = 40, min_docs: int = 2, originals: DataFrame | None = None, by: str = "max") -> DataFrame:
    """Terms of all feedback documents together; original query terms are exempt from the document minimum."""
    rows = pooled(feedback, index)
    if originals is not None:
        rows = rows.join(F.broadcast(originals.select("topic_id", "term", F.lit(True).alias("own"))), ["topic_id", "term"], "left").where((F.col("fb_df") >= min_docs) | F.col("own"))
    else:
        rows = rows.where(F.col("fb_df") >= min_docs)
    return best_terms(rows.select("topic_id", "term", QE_MODELS[model]().alias("weight")), k, by)


def select_rocchio(feedback: DataFrame, index: Index, model: str = "Bo1", k: int = 40, min_docs: int = 0, by: str = "max") -> DataFrame:
    """Each document weighed alone; the mean over the topic's documents."""
    docs = bounded(feedback.select("topic_id", "doc_id"))
    n = docs.groupBy("topic_id").agg(F.count("*").alias("n_docs"))
    rows = index.postings.select("term", "doc_id", F.col("tf").alias("fb_tf"), F.col("dl").alias("fb_len")).join(docs, "doc_id").withColumn("fb_df", F.lit(1))
    rows = rows.join(index.lexicon, "term").crossJoin(F.broadcast(index.stats))
    means = rows.groupBy("topic_id", "term").agg(F.sum(QE_MODELS[model]()).alias("total"), F.count("*").alias("fb_df")).where(F.col("fb_df") >= min_docs).join(F.broadcast(n), "topic_id")
    return best_terms(means.select("topic_id", "term", (F.col("total") / F.col("n_docs")).alias("weight")), k, by)


def select_rm3(feedback: DataFrame, index: Index, query: DataFrame, k: int = 40, mu: float = 500.0, min_docs: int = 2) -> DataFrame:
    """Relevance model: smoothed term shares of the documents, weighed by the query's likelihood in each."""
    docs = bounded(feedback.select("topic_id", "doc_id"))
    share = (F.col("tf") + mu * F.col("ctf") / F.col("T")) / (F.col("dl") + mu)
    found = kept(index.postings.select("term", "doc_id", "tf", "dl").join(docs, "doc_id"), "feedback")  # one scan of the postings
    rows = kept(found.join(index.lexicon, "term").crossJoin(F.broadcast(index.stats)), "feedback")
    lengths = rows.groupBy("topic_id", "doc_id").agg(F.first("dl").alias("dl"))
    wanted = query.select("topic_id", "term", "qtf").join(index.lexicon, "term").crossJoin(F.broadcast(index.stats))
    cells = lengths.join(F.broadcast(wanted), "topic_id").join(rows.select("topic_id", "doc_id", "term", "tf"), ["topic_id", "doc_id", "term"], "left").fillna(0, ["tf"])
    likelihood = cells.groupBy("topic_id", "doc_id").agg(F.sum(F.col("qtf") * F.log(share)).alias("ll"))
    topic = Window.partitionBy("topic_id")
    likelihood = likelihood.withColumn("w", F.exp(F.col("ll") - F.max("ll").over(topic)))
    likelihood = likelihood.withColumn("w", F.col("w") / F.sum("w").over(topic)).select("topic_id", "doc_id", "w")
    weighed = rows.join(F.broadcast(likelihood), ["topic_id", "doc_id"]).groupBy("topic_id", "term").agg(F.sum(F.col("w") * share).alias("weight"), F.count("*").alias("fb_df")).where(F.col("fb_df") >= min_docs)
    return best_terms(weighed.select("topic_id", "term", "weight"), k, "sum")


def select_divergence(feedback: DataFrame, index: Index, k: int = 40, mu: float = 500.0, weight: float = 0.5, min_docs: int = 2) -> DataFrame:
    """Divergence minimisation: exp of the mean log share in the documents less ``weight`` times the collection's."""
    docs = bounded(feedback.select("topic_id", "doc_id"))
    n = docs.groupBy("topic_id").agg(F.count("*").alias("n_docs"))
    lengths = index.postings.join(docs, "doc_id").groupBy("topic_id", "doc_id").agg(F.first("dl").alias("dl"))
    stats = index.lexicon.crossJoin(F.broadcast(index.stats))
    seen = index.postings.select("term", "doc_id", "tf").join(docs, "doc_id")
    terms = seen.groupBy("topic_id", "term").agg(F.count("*").alias("fb_df")).where(F.col("fb_df") >= min_docs).join(stats, "term")
    cells = terms.join(F.broadcast(lengths), "topic_id").join(seen, ["topic_id", "doc_id", "term"], "left").fillna(0, ["tf"])
    share = (F.col("tf") + mu * F.col("ctf") / F.col("T")) / (F.col("dl") + mu)
    mean = cells.groupBy("topic_id", "term").agg(F.sum(F.log(share)).alias("logs"), F.first(F.col("ctf") / F.col("T")).alias("p")).join(F.broadcast(n), "topic_id")
    return best_terms(mean.select("topic_id", "term", F.exp((F.col("logs") / F.col("n_docs") - weight * F.log("p")) / (1 - weight)).alias("weight")), k, "sum")


def select_lca(feedback: DataFrame, index: Index, query: DataFrame, k: int = 40, delta: float = 0.01) -> DataFrame:
    """Local context analysis: the product over query terms of delta + idf * log10(1 + co-occurrence) / log10(n)."""
    docs = bounded(feedback.select("topic_id", "doc_id"))
    n = docs.groupBy("topic_id").agg(F.count("*").alias("n_docs"))
    rows = index.postings.select("term", "doc_id", "tf").join(docs, "doc_id")
    own = rows.join(F.broadcast(query.select("topic_id", "term")), ["topic_id", "term"]).select("topic_id", "doc_id", F.col("term").alias("q"), F.col("tf").alias("qf"))
    met = rows.join(own, ["topic_id", "doc_id"]).groupBy("topic_id", "term", "q").agg(F.sum(F.col("tf") * F.col("qf")).alias("co"))
    idf = index.lexicon.crossJoin(F.broadcast(index.stats)).select("term", lg(F.col("N") / F.col("df")).alias("idf"))
    size = F.greatest(F.log10("n_docs"), F.lit(1e-9))
    factor = delta + F.sqrt(F.abs("idf")) * F.log10(1 + F.col("co")) / size
    cells = met.join(idf, "term").join(F.broadcast(n), "topic_id").groupBy("topic_id", "term").agg(F.sum(F.log(factor)).alias("logs"), F.count("*").alias("hits"))
    total = query.groupBy("topic_id").agg(F.count("*").alias("n_query"))
    return best_terms(cells.join(F.broadcast(total), "topic_id").select("topic_id", "term", F.exp(F.col("logs") + (F.col("n_query") - F.col("hits")) * F.log(F.lit(delta))).alias("weight")), k)


def expand_add(query: DataFrame, terms: DataFrame, beta: float = 1.0) -> DataFrame:
    """qtf / max(qtf) + beta * weight."""
    top = F.max("qtf").over(Window.partitionBy("topic_id"))
    both = query.select("topic_id", "term", (F.col("qtf") / top).alias("qtf")).unionByName(terms.select("topic_id", "term", (beta * F.col("weight")).alias("qtf")))
    return both.groupBy("topic_id", "term").agg(F.sum("qtf").alias("qtf")).withColumn("ql", F.sum("qtf").over(Window.partitionBy("topic_id")))


def expand_interpolate(query: DataFrame, terms: DataFrame, alpha: float = 0.5, k: int | None = None) -> DataFrame:
    """(1 - alpha) of the query's shares and alpha of the terms', cut to k and made to sum to 1."""
    topic = Window.partitionBy("topic_id")
    both = query.select("topic_id", "term", ((1 - alpha) * F.col("qtf") / F.sum("qtf").over(topic)).alias("weight")).unionByName(terms.select("topic_id", "term", (alpha * F.col("weight")).alias("weight")))
    merged = both.groupBy("topic_id", "term").agg(F.sum("weight").alias("weight"))
    return best_terms(merged, k or 1 << 30, "sum").select("topic_id", "term", F.col("weight").alias("qtf"), F.lit(1.0).alias("ql"))


# Re-ranking


def host_dedup(run: DataFrame, urls: DataFrame, keep: int = 5) -> DataFrame:
    """The best ``keep`` documents of each host, ranked again: urls (doc_id, url)."""
    rows = run.join(urls.select("doc_id", F.parse_url("url", F.lit("HOST")).alias("host")), "doc_id", "left")
    place = F.row_number().over(Window.partitionBy("topic_id", "host").orderBy("rank"))
    first = rows.withColumn("place", place).where((F.col("place") <= keep) | F.col("host").isNull())
    return range_ranks(first.drop("host", "place"), [F.col("rank")], ("topic_id",), "again").select("topic_id", "doc_id", "score", F.col("again").alias("rank"))


def mitra(run: DataFrame, index: Index, query: DataFrame, top: int = 100, share: float | None = None) -> DataFrame:
    """Sum over a document's query terms, rarest first, of idf times one less the largest chance of meeting it with the ones before."""
    docs = run.where(F.col("rank") <= top).select("topic_id", "doc_id", "score")
    idf = index.lexicon.crossJoin(F.broadcast(index.stats)).select("term", lg(F.col("N") / F.col("df")).alias("idf"))
    rows = index.postings.select("term", "doc_id").join(bounded(docs.select("topic_id", "doc_id")), "doc_id").join(F.broadcast(query.select("topic_id", "term")), ["topic_id", "term"]).join(idf, "term")
    counts = rows.groupBy("topic_id", "term").agg(F.count("*").alias("n"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, ["topic_id", "doc_id"]).where("a.term <> b.term").groupBy("topic_id", F.col("a.term").alias("term"), F.col("b.term").alias("other")).agg(F.count("*").alias("both"))
    given = pairs.join(counts.withColumnRenamed("term", "other"), ["topic_id", "other"]).select("topic_id", "term", "other", (F.col("both") / F.col("n")).alias("p"))
    a2, b2 = rows.alias("a"), rows.alias("b")
    earlier = (F.col("b.idf") > F.col("a.idf")) | ((F.col("b.idf") == F.col("a.idf")) & (F.col("b.term") < F.col("a.term")))
    before_ = a2.join(b2, ["topic_id", "doc_id"]).where(earlier).select("topic_id", "doc_id", F.col("a.term").alias("term"), F.col("b.term").alias("other"))
    worst = before_.join(given, ["topic_id", "term", "other"]).groupBy("topic_id", "doc_id", "term").agg(F.max("p").alias("p"))
    fresh = rows.join(worst, ["topic_id", "doc_id", "term"], "left").groupBy("topic_id", "doc_id").agg(F.sum(F.col("idf") * (1 - F.coalesce("p", F.lit(0.0)))).alias("fresh"))
    joined = docs.join(fresh, ["topic_id", "doc_id"], "left").fillna(0.0, ["fresh"])
    value = F.col("fresh") if share is None else share * F.col("fresh") + (1 - share) * F.col("score")
    return joined.select("topic_id", "doc_id", value.alias("score"))


def rerank_with(run: DataFrame, rescored: DataFrame) -> DataFrame:
    """Only the documents of ``run``, by the scores of ``rescored``."""
    return run.select("topic_id", "doc_id").join(rescored, ["topic_id", "doc_id"])


def residual(run: DataFrame, judged: DataFrame) -> DataFrame:
    """The run without documents already judged for the topic, ranked again."""
    left = run.join(judged.select("topic_id", "doc_id"), ["topic_id", "doc_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy("rank")))


def features(run: DataFrame, index: Index, query: DataFrame) -> DataFrame:
    """Per document: score, length gap, share of the query's terms, and that share weighed by idf."""
    idf = index.lexicon.crossJoin(F.broadcast(index.stats)).select("term", lg(F.col("N") / F.col("df")).alias("idf"))
    wanted = query.select("topic_id", "term").join(idf, "term")
    totals = wanted.groupBy("topic_id").agg(F.count("*").alias("n_query"), F.sum("idf").alias("total"))
    rows = index.postings.select("term", "doc_id", "dl").join(F.broadcast(wanted), "term").join(run.select("topic_id", "doc_id", "score"), ["topic_id", "doc_id"])
    grouped = rows.groupBy("topic_id", "doc_id").agg(F.first("score").alias("score"), F.first("dl").alias("dl"), F.count("*").alias("hits"), F.sum("idf").alias("mass"))
    return grouped.join(F.broadcast(totals), "topic_id").crossJoin(F.broadcast(index.stats)).select(
        "topic_id", "doc_id", "score", F.abs(F.col("avdl") - F.col("dl")).alias("length_gap"), (F.col("hits") / F.col("n_query")).alias("share"), (F.col("mass") / F.col("total")).alias("idf_share"))


def rerank_by_classifier(run: DataFrame, index: Index, terms: DataFrame, top: int = 10, bottom: int = 10, depth: int = 50, share: float = 0.5, steps: int = 200) -> DataFrame:
    """Pseudo-labels from a topic's first and last documents train a logistic regression on tf-idf of ``terms``; the first
    ``depth`` documents are scored again.

    A topic's rows are depth + bottom documents times its expansion terms, so they fit one task.
    """
    import numpy as np
    import pandas as pd

    last = F.max("rank").over(Window.partitionBy("topic_id"))
    chosen = run.withColumn("last", last).where((F.col("rank") <= depth) | (F.col("rank") > F.col("last") - bottom))
    weight = (1 + F.log(F.col("tf"))) * lg(F.col("N") / F.col("df"))
    docs = bounded(chosen.select("topic_id", "doc_id"))
    found = kept(index.postings.select("term", "doc_id", "tf").join(docs, "doc_id").join(bounded(terms.select("topic_id", "term")), ["topic_id", "term"]), "feedback")  # only of these documents
    rows = found.join(index.lexicon, "term").crossJoin(F.broadcast(index.stats)).select("topic_id", "doc_id", "term", weight.alias("weight"))
    vectors = chosen.join(rows, ["topic_id", "doc_id"], "left").groupBy("topic_id", "doc_id", "rank", "last", "score").agg(F.collect_list(F.struct("term", "weight")).alias("features"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        names = sorted({f["term"] for fs in frame["features"] for f in fs if f["term"] is not None})
        place = {t: k for k, t in enumerate(names)}
        x = np.zeros((len(frame), len(names) + 1))
        x[:, -1] = 1
        for row, fs in enumerate(frame["features"]):
            for f in fs:
                if f["term"] is not None:
                    x[row, place[f["term"]]] = f["weight"]
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(norm > 0, norm, 1)
        good, bad = (frame["rank"] <= top).to_numpy(), (frame["rank"] > frame["last"] - bottom).to_numpy()
        train = good | bad
        w, y = np.zeros(x.shape[1]), good[train].astype(float)
        for _ in range(steps):
            w -= 0.5 * (x[train].T @ (1 / (1 + np.exp(-x[train] @ w)) - y) / max(1, train.sum()) + 1e-3 * w)
        p = 1 / (1 + np.exp(-x @ w))
        old = frame["score"].to_numpy(float)
        old = (old - old.min()) / max(1e-12, old.max() - old.min())
        out = frame[["topic_id", "doc_id", "rank"]].assign(score=share * p + (1 - share) * old)
        return out[out["rank"] <= depth][["topic_id", "doc_id", "score"]]

    return vectors.groupBy("topic_id").applyInPandas(learn, run.select("topic_id", "doc_id", F.col("score").cast("double")).schema)
