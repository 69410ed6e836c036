"""Mixing documents to target weights of domains, in column expressions only (operator 2).

A classifier learned from a labelled table gives every document a chance for each domain
(naive Bayes over the words that tell the domains apart best). Every document gets a rate,
the expected number of its copies in the mixture. Rates are fitted by least squares: the
expected tokens of domain k, sum over documents of tokens * chance_k * rate, shall be the
target's share of the token budget. Projected gradient: each step needs one sum per domain
over all documents, after which every document moves its own rate and stays at 0 or more.
Steps are taken in the metric of the documents' tokens and scaled by the domains' tokens;
then the greatest curvature is 1, so a step of 1 never diverges.

Nulls: a null text has no tokens and the prior's chances; a labelled row with a null
domain or text is left out; domains without a target are one domain, `other`, of weight 0;
targets without a labelled document are dropped and the others keep their proportion.
Without any labelled document all rates are 1. An empty table gives an empty result.
Rows are fitted one by one; repeated rows get equal rates. Texts are read whole, however
long; extra columns are not read. Words are told by 64-bit hashes. Targets that are not met
within the steps allowed give a warning with what they miss.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import bitmaps, few, maybe_in, query, stored, table

WORD = r"[^\x20\x09-\x0D]+"
OTHER = "other"
BROADCAST_LABELS = 2_000_000    # labelled ids sent to every task, about 40 bytes each
# Shares of the mixture; documents of low quality and toxic ones belong to no target.
TARGETS = {"en/high": 0.4, "de/high": 0.2, "fr/high": 0.2, "es/high": 0.2}


def all_words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def summed(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


class Domains:
    """Names, log priors, and per word (its hash) the log odds of each domain against all."""

    def __init__(self, names: list[str], priors: list[float], words: DataFrame | None):
        self.names, self.priors, self.words = names, priors, words
        self.odds = [f"_lq_odds{k}" for k in range(len(names))]


def learn_domains(labelled: DataFrame, known: list[str], vocabulary: int = 4096, least: int = 5) -> Domains:
    """labelled: text, domain. Words are counted per domain over all labelled rows; the
    vocabulary is the `vocabulary` words with most information about the domain. A domain's
    counts are filled up with half a word of the vocabulary each, in the proportions of all
    domains, so that a domain of few words does not draw the words it never had."""
    rows = labelled.where("text IS NOT NULL AND domain IS NOT NULL")
    domain = F.when(F.col("domain").isin(known), F.col("domain")).otherwise(OTHER)
    shares = {r["domain"]: r["n"] for r in rows.groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(shares)
    if not names:
        return Domains([], [], None)
    number = F.array_position(F.array(*[F.lit(d) for d in names]), domain).cast("int") - 1
    each = rows.select(number.alias("k"), F.explode(all_words()).alias("word"))
    counts = stored(each.select("k", F.xxhash64("word").alias("word")).groupBy("k", "word")
                    .agg(F.count(F.lit(1)).alias("n")), "domain-words")
    sizes = {names[r["k"]]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return Domains([], [], None)
    every = sum(sizes.values())
    wide = counts.groupBy("word").agg(F.sum("n").alias("all"), *[
        F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(names))])
    wide = stored(wide.where(F.col("all") >= least), "word-counts")
    fill, share = max(wide.count() / 2, 1.0), F.col("all") / every
    odds = [F.log((F.col(f"n{k}") + fill * share) / (sizes.get(d, 0) + fill)) - F.log(share) for k, d in enumerate(names)]
    told = summed([F.col(f"n{k}") * o for k, o in enumerate(odds)])
    found = Domains(names, [shares[d] / sum(shares.values()) for d in names], None)
    found.words = stored(wide.orderBy(F.desc(told), "word").limit(vocabulary)
                         .select("word", *[o.alias(c) for o, c in zip(odds, found.odds, strict=True)]), "domain-odds")
    return found


def memberships(docs: DataFrame, domains: Domains, evidence: int = 40) -> DataFrame:
    """doc_id, tokens, p (chance per domain). Words are not independent, so the evidence
    of a text counts as that of at most `evidence` words."""
    rows = docs.select(F.monotonically_increasing_id().alias("_lq_row"), "doc_id", all_words().alias("_lq_words"))
    each = rows.select("_lq_row", "doc_id", F.explode_outer("_lq_words").alias("word")).withColumn(
        "word", F.when(F.col("word").isNotNull(), F.xxhash64("word")))
    # at most `vocabulary` words by the number of targets: a bound that no corpus moves
    joined = each.join(F.broadcast(domains.words), "word", "left")
    sums = joined.groupBy("_lq_row", "doc_id").agg(
        F.count("word").alias("tokens"), F.count(domains.odds[0]).alias("_lq_known"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in domains.odds])
    scale = F.least(F.lit(1.0), F.lit(float(evidence)) / F.greatest(F.col("_lq_known"), F.lit(1)))
    logs = [F.col(c) * scale + F.log(F.lit(float(p))) for c, p in zip(domains.odds, domains.priors, strict=True)]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    exps = [F.exp(x - top) for x in logs]
    total = summed(exps)
    return sums.select("doc_id", "tokens", *[(e / total).alias(f"p{k}") for k, e in enumerate(exps)])


def fit_rates(members: DataFrame, shares: list[float], budget: float | None = None, most_steps: int = 60,
              tolerance: float = 1e-3, settle_every: int = 8) -> DataFrame:
    """members (settled): tokens, p0, p1 ...; adds `rate`. Stops when no domain is further
    from its target than `tolerance` of the budget."""
    chances = [f"p{k}" for k in range(len(shares))]
    mass = members.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"), *[
        F.coalesce(F.sum(F.col("tokens") * F.col(c)), F.lit(0.0)).alias(c) for c in chances]).first()
    if not mass["all"]:
        return members.withColumn("rate", F.lit(1.0))
    budget = float(mass["all"]) if budget is None else budget
    target = [s * budget for s in shares]
    held = [max(mass[c], 1e-9) for c in chances]
    start = summed([F.col(c) * (t / h) for c, t, h in zip(chances, target, held, strict=True)])
    state = members.withColumn("rate", start)
    for step in range(1, most_steps + 1):
        got = state.agg(*[F.sum(F.col("tokens") * F.col(c) * F.col("rate")).alias(c) for c in chances]).first()
        miss = [got[c] - t for c, t in zip(chances, target, strict=True)]
        if max(map(abs, miss)) <= tolerance * budget:
            break
        move = summed([F.col(c) * (m / h) for c, m, h in zip(chances, miss, held, strict=True)])
        state = state.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - move))
        if step % settle_every == 0:
            state = stored(state, "rates")
    else:
        warnings.warn(f"mixing: after {most_steps} steps a domain was {max(map(abs, miss)) / budget:.4f} of the "
                      "tokens away from its target", stacklevel=2)
    return state


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS,
        budget: float | None = None) -> DataFrame:
    """doc_id, tokens, domain (the likeliest), chance, rate, copies for every row of docs.
    copies: the rate's whole part, and one more for the fraction's share of the ids' hashes."""
    domains = learn_domains(labelled, sorted(targets))
    if not domains.names:
        return docs.select("doc_id", F.size(all_words()).cast("long").alias("tokens"),
                           F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("chance"),
                           F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    members = stored(memberships(docs, domains), "memberships")
    weights = [targets.get(d, 0.0) for d in domains.names]
    shares = [w / sum(weights) if sum(weights) else 1 / len(weights) for w in weights]
    rated = fit_rates(members, shares, budget)
    chances = F.array(*[F.col(f"p{k}") for k in range(len(domains.names))])
    best = F.array_max(chances)
    name = F.element_at(F.array(*[F.lit(d) for d in domains.names]), F.array_position(chances, best).cast("int"))
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor("rate") + (place < F.col("rate") - F.floor("rate")).cast("long")
    return rated.select("doc_id", "tokens", name.alias("domain"), best.alias("chance"), "rate",
                        copies.alias("copies"))


def labelled_domains(docs: DataFrame, labels: DataFrame, most: int = BROADCAST_LABELS) -> DataFrame:
    """text and domain (language/high or language/low) of the labelled documents. Up to
    `most` labelled ids go to every task; beyond, only texts that a filter of the ids lets
    through are shuffled to them."""
    high = F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0))
    known = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
             .groupBy(F.col("doc_id").alias("_lq_id")).agg(high.alias("_lq_high")))
    known = stored(known, "verdicts")
    slim = docs.select("doc_id", "text", "lang")
    if few(known, most):
        known = F.broadcast(known)
    else:
        slim = maybe_in(slim, F.col("doc_id"), stored(bitmaps(known, F.col("_lq_id")), "verdicts-filter"))
    return slim.join(known, slim["doc_id"] == known["_lq_id"]).select("text", F.concat(
        F.coalesce("lang", F.lit("und")), F.when(F.col("_lq_high") == 1, "/high").otherwise("/low")).alias("domain"))


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that bring the languages' documents of high quality to their target shares."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))
