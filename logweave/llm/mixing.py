"""Operator 3: mixing to target weights with soft membership.

1. A naive Bayes classifier over hashed tokens is counted on a labelled table
   (a bounded sample of it: ``train_rows``), and its one temperature is chosen
   on a fifth of those rows that is not counted.  It gives every document a
   posterior over the domains.
2. Rates r >= 0 are fitted so that the expected tokens of each domain,
   S_d = sum_i r_i n_i p_id, meet their targets T_d: projected gradient steps
   (accelerated, from r = 1) on the squared distance of S from T.  Distances
   are measured in (S_d - T_d) / sqrt(T_d) and by the inverse Gram matrix of
   the documents' posteriors, in the metric of their sizes, so that one step
   is exact where no rate meets 0.  A step needs the few sums S_d only: a job
   folds the steps so far over a compact table (no text) and adds up; every
   ``store_every`` steps the table is stored with the rates.

Edge cases: null and empty texts and texts without tokens have the prior as
posterior and rate 1; rows equal in doc_id and text are one document, with
``rows`` of them; null labels are ignored, a document labelled twice takes the
smaller domain name; unlabelled domains keep a smoothed prior; targets that no
rates can meet are met as nearly as least squares does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logweave.llm.common import stored

BUCKETS = 1 << 16
TOKEN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+"
TEMPERATURES = (1, 2, 4, 8, 16, 32, 64, 128, 256)


def _tokens(docs: DataFrame, *more: str) -> DataFrame:
    """A row per token with its bucket; a text without tokens has one row with null."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), *more,
                       F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    rows = rows.select("doc_id", "text_hash", *more, F.posexplode_outer("tokens").alias("place", "token"))
    return rows.withColumn("bucket", F.when(F.col("token").isNotNull(), F.pmod(F.xxhash64("token"), F.lit(BUCKETS)))).drop("token")


def _scores(tokens: DataFrame, weights: DataFrame, domains: list[str], *keys: str) -> DataFrame:
    """Per document: tokens, equal rows, and the mean weight of its tokens for each domain."""
    joined = tokens.join(F.broadcast(weights), "bucket", "left")  # at most BUCKETS rows
    sums = [F.sum(f"w{i}").alias(f"s{i}") for i in range(len(domains))]
    per_doc = joined.groupBy("doc_id", "text_hash", *keys).agg(
        F.count("bucket").alias("all_tokens"), F.count(F.when(F.coalesce("place", F.lit(0)) == 0, 1)).alias("rows"), *sums)
    mean = [(F.coalesce(f"s{i}", F.lit(0.0)) / F.greatest("all_tokens", F.lit(1))).alias(f"s{i}") for i in range(len(domains))]
    return per_doc.select("doc_id", "text_hash", *keys, (F.col("all_tokens") / F.col("rows")).cast("long").alias("n_tokens"), "rows", *mean)


def _posterior(prior: dict[str, float], temperature: float | Column) -> list[Column]:
    logits = [F.lit(float(np.log(p))) + temperature * F.col(f"s{i}") for i, p in enumerate(prior.values())]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    powers = [F.exp(x - top) for x in logits]
    return [x / sum(powers[1:], powers[0]) for x in powers]


def _losses(held: DataFrame, prior: dict[str, float]) -> DataFrame:
    """(t, loss) of each temperature.  A row per document and temperature, so that the plan has one expression for all."""
    tried = held.withColumn("t", F.explode(F.array(*map(F.lit, TEMPERATURES))))
    p = _posterior(prior, F.col("t"))
    own = F.coalesce(*[F.when(F.col("domain") == d, p[i]) for i, d in enumerate(prior)])
    return tried.groupBy("t").agg(F.coalesce(F.sum(-F.log(F.greatest(own, F.lit(1e-12)))), F.lit(0.0)).alias("loss"))


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], train_rows: int = 5000) -> DataFrame:
    """(doc_id, text_hash, n_tokens, rows, p0, p1, ...): the domains' posteriors of every document.

    ``labels``: doc_id, domain.  At most ``train_rows`` of them are used, in the order of a hash of the id."""
    chosen = (labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).withColumn("tunes", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0))
    chosen = stored(chosen, "mixing-labels")
    seen = {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    prior = {d: (seen.get(d, 0) + 1) / (sum(seen.values()) + len(domains)) for d in domains}
    labelled = _tokens(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "domain", "tunes")  # at most train_rows rows
    of = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"c{i}") for i, d in enumerate(domains)]
    counts = stored(labelled.where("not tunes and bucket is not null").groupBy("bucket").agg(*of), "mixing-counts")
    totals = counts.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(domains))]).first()
    logs = [F.log((F.col(f"c{i}") + .5) / (totals[i] + .5 * BUCKETS)) for i in range(len(domains))]
    mean = sum(logs[1:], logs[0]) / len(logs)
    weights = counts.select("bucket", *[(x - mean).alias(f"w{i}") for i, x in enumerate(logs)])
    held = _scores(labelled.where("tunes"), weights, domains, "domain")
    losses = {r["t"]: r["loss"] for r in _losses(held, prior).collect()}  # a row per temperature
    loss = [losses.get(t, 0.0) for t in TEMPERATURES]
    temperature = TEMPERATURES[int(np.argmin(loss))]
    scored = _scores(_tokens(docs), weights, domains)
    return scored.select("doc_id", "text_hash", "n_tokens", "rows",
                         *[x.alias(f"p{i}") for i, x in enumerate(_posterior(prior, temperature))])


def _sums(rows: DataFrame, terms: list[Column]) -> np.ndarray:
    """The sums of ``terms``, added up as the rows are gone through: one job without a shuffle; nothing is written."""
    seen = Observation()
    rows.select(*[x.cast("double").alias(f"t{i}") for i, x in enumerate(terms)]).observe(
        seen, *[F.sum(f"t{i}").alias(f"s{i}") for i in range(len(terms))]).write.format("noop").mode("overwrite").save()
    return np.array([seen.get[f"s{i}"] for i in range(len(terms))], float)


def fit_rates(soft: DataFrame, targets: list[float], tolerance: float = 1e-3, max_steps: int = 60,
              store_every: int = 10) -> DataFrame:
    """Adds ``rate``.  ``soft``: n_tokens, rows and p0, p1, ...; ``targets``: weights, or shares, of the domains.

    Targets are scaled to the tokens there are, so that the mean rate stays about 1."""
    n = len(targets)
    soft = stored(soft, "mixing-soft")
    size = F.col("n_tokens") * F.col("rows")
    first = soft.agg(F.sum(size).alias("all"), *[F.sum(size * F.col(f"p{i}")).alias(f"m{i}") for i in range(n)],
                     *[F.sum(size * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(n)]).first()
    if not first["all"]:
        return soft.withColumn("rate", F.lit(1.0))
    weight = np.array(targets, float) / sum(targets)
    goal = np.maximum(weight, 1e-9) * float(first["all"])
    gram = np.array([[first[f"g{i}_{j}"] for j in range(n)] for i in range(n)], float) / np.sqrt(np.outer(goal, goal))
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    state = soft.withColumn("rate", F.lit(1.0)).withColumn("last", F.lit(1.0))
    sums = before = np.array([first[f"m{i}"] for i in range(n)], float)
    momentum, history = 1.0, []
    p = F.array(*[F.col(f"p{i}") for i in range(n)])

    def after(steps: list[tuple[np.ndarray, float]]) -> DataFrame:
        if not steps:
            return state
        moves = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in g]).alias("g"), F.lit(float(b)).alias("b")) for g, b in steps])

        def one(s: Column, m: Column) -> Column:
            ahead = s["rate"] + m["b"] * (s["rate"] - s["last"])
            slope = F.aggregate(F.zip_with("p", m["g"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
            return F.struct(F.greatest(F.lit(0.0), ahead - slope).alias("rate"), s["rate"].alias("last"))

        moved = state.withColumn("p", p).withColumn("s", F.aggregate(moves, F.struct("rate", "last"), one))
        return (moved.withColumn("rate", F.when(F.col("n_tokens") > 0, F.col("s.rate")).otherwise(1.0))
                .withColumn("last", F.when(F.col("n_tokens") > 0, F.col("s.last")).otherwise(1.0)).drop("p", "s"))

    for _ in range(max_steps):
        if np.all(np.abs(sums - goal) <= tolerance * goal):
            break
        following = (1 + (1 + 4 * momentum ** 2) ** .5) / 2
        ahead = (momentum - 1) / following
        at = sums + ahead * (sums - before)
        history.append((inverse @ ((at - goal) / np.sqrt(goal)) / np.sqrt(goal), ahead))
        momentum = following
        before, sums = sums, _sums(after(history), [size * F.col(f"p{i}") * F.col("rate") for i in range(n)])
        if len(history) == store_every:
            state, history = stored(after(history), "mixing-rates"), []
    return after(history).drop("last")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], train_rows: int = 5000) -> DataFrame:
    """A row per document: doc_id, text_hash, rows, n_tokens, a posterior per domain, rate, and copies.

    ``copies`` realises the rate: its whole part, and one more for the share of ids that its fraction says (by hash)."""
    domains = sorted(targets)
    rated = fit_rates(posteriors(docs, labels, domains, train_rows), [targets[d] for d in domains])
    draw = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "text_hash"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return rated.select("doc_id", "text_hash", "rows", "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)],
                        "rate", copies.alias("copies"))


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of a table of quality and toxicity marks: toxic, else poor, else good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")
