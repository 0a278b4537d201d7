"""From stored votes to training pairs: cleaning, splitting, balancing, mining and monitoring.

All functions take flat stored feedback.  A pair is a query (its three key columns) with an item; a
vote without a label counts as rejected.  Statistics are partial aggregations before their shuffle, a
"latest" vote is an aggregate too, and windows hold a bounded number of rows, so a query, pair or
session with a third of all votes costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogmatch.functions.text import words
from catalogmatch.operators.feedback import KEY, query_key
from catalogmatch.operators.pair_ranks import rank_pairs
from catalogmatch.operators.quantiles import exact_quantiles
from catalogmatch.session import shared_dir

ITEM = "match_cd_insumo"
PAIR = [*KEY, ITEM]

# ---- fixed values: limits of the curation plan ----
TRAIN_PERCENT = 80
MAX_CLASS_RATIO = 1.5
MAX_PER_QUERY = 10
MIN_CONTESTED_VOTES = 3
HARD_SCORE, SEMI_HARD_SCORE, HARD_RANK, HARD_WEIGHT = 0.7, 0.5, 30, 2.0
MIN_GAIN_POINTS, MAX_LOSS_POINTS = 5.0, 2.0
AB_MIN_VOTES = 200
RETRAIN_ROWS = 500
# ---- end of fixed values ----


def _approved() -> Column:
    return F.coalesce(F.col("label") == 1, F.lit(False))


def _digits(text: Column, count: int = 4) -> Column:
    """The first hex digits of the MD5 of a text as a number."""
    return F.conv(F.substring(F.md5(text), 1, count), 16, 10).cast("long")


def label_distribution(feedback: DataFrame) -> DataFrame:
    """Approved and rejected votes, and approved per rejected (null without any)."""
    counted = feedback.agg(F.count_if(_approved()).alias("approved"), F.count_if(~_approved()).alias("rejected"))
    return counted.withColumn("ratio", F.try_divide(F.col("approved").cast("double"), F.col("rejected").cast("double")))


def votes_per_query_hist(feedback: DataFrame) -> DataFrame:
    """How many queries have how many votes."""
    return query_key(feedback).groupBy(KEY).agg(F.count("*").alias("votes")).groupBy("votes").agg(F.count("*").alias("queries"))


def score_by_label(feedback: DataFrame) -> DataFrame:
    """Distribution of the vector score of approved and rejected votes, on the scores as they are.

    Scores that are missing or no finite number are left out.
    """
    rows = feedback.select(F.when(_approved(), "approved").otherwise("rejected").alias("outcome"), F.col("score_sbert").cast("double").alias("s"))
    rows = rows.where(F.abs("s") < float("inf"))
    moments = rows.groupBy("outcome").agg(F.count("*").alias("votes"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("deviation"))
    quartiles = exact_quantiles(rows, "outcome", "s", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(F.broadcast(quartiles), "outcome")  # two rows


def latest_votes(feedback: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The last vote on each pair (or each group of ``by``); ties go to the greater ``feedback_id``."""
    columns = ["timestamp_utc", "feedback_id", "session_id", "label"]
    last = query_key(feedback).groupBy(by or PAIR).agg(F.max(F.struct(*columns)).alias("last"))
    return last.select(*(by or PAIR), *[f"last.{c}" for c in columns if c not in (by or PAIR)])


def contradictions(feedback: DataFrame) -> DataFrame:
    """Pairs that some sessions approve and others reject."""
    sessions = query_key(feedback).groupBy(*PAIR, "session_id").agg(
        F.count_if(_approved()).alias("approved"), F.count_if(~_approved()).alias("rejected"))
    pairs = sessions.groupBy(PAIR).agg(
        F.sum("approved").alias("approved"), F.sum("rejected").alias("rejected"), F.count("*").alias("sessions"))
    return pairs.where("approved > 0 and rejected > 0 and sessions > 1")


def resolve_votes(feedback: DataFrame) -> DataFrame:
    """One outcome per pair from the last vote of each session.

    Sessions that agree settle it.  Contested pairs with fewer than three votes are dropped; others
    go by majority, and a tie is ``uncertain``.
    """
    votes = latest_votes(feedback, [*PAIR, "session_id"]).groupBy(PAIR).agg(
        F.count("*").alias("votes"), F.count_if(_approved()).alias("approved"))
    contested = (F.col("approved") > 0) & (F.col("approved") < F.col("votes"))
    twice = 2 * F.col("approved")
    outcome = F.when(twice > F.col("votes"), "approved").when(twice < F.col("votes"), "rejected").otherwise("uncertain")
    return votes.where(~contested | (F.col("votes") >= MIN_CONTESTED_VOTES)).withColumn("outcome", outcome)


def split_by_query(feedback: DataFrame, percent: int = TRAIN_PERCENT) -> DataFrame:
    """Add ``split``: all votes on one query description are either ``train`` or ``test``."""
    return _split(query_key(feedback), F.col("key_descricao"), percent)


def split_by_vote(feedback: DataFrame, percent: int = TRAIN_PERCENT) -> DataFrame:
    """Add ``split`` vote by vote, which leaks queries; here for ``leak_check`` to find."""
    return _split(query_key(feedback), F.col("feedback_id"), percent)


def _split(keyed: DataFrame, key: Column, percent: int) -> DataFrame:
    return keyed.withColumn("split", F.when(_digits(key) % 100 < percent, "train").otherwise("test"))


def leak_check(split: DataFrame) -> DataFrame:
    """Query descriptions with votes in both parts; none in a sound split."""
    return split.groupBy("key_descricao").agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test")).where(
        "train > 0 and test > 0")


def balance_classes(feedback: DataFrame, ratio: float = MAX_CLASS_RATIO) -> DataFrame:
    """Approved votes thinned to ``ratio`` per rejected one; rejected votes all stay.

    The approved with the least MD5 of their id stay.  Their number per range of hashes tells which
    range holds the last of them, so only that range is ranked.
    """
    quota = int(feedback.where(~_approved()).count() * ratio)
    hashed = feedback.where(_approved()).withColumn("_range", _digits(F.col("feedback_id")))
    ranges = hashed.groupBy("_range").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = ranges.withColumn("below", below).where(F.col("below") < quota)  # at most 65,536 rows
    kept = hashed.join(F.broadcast(places), "_range")
    whole = kept.where(F.col("below") + F.col("n") <= quota)
    order = Window.partitionBy("_range").orderBy(F.md5("feedback_id"), "feedback_id")
    last = kept.where(F.col("below") + F.col("n") > quota).withColumn("_place", F.row_number().over(order)).where(
        F.col("below") + F.col("_place") <= quota)
    return feedback.where(~_approved()).unionByName(whole.select(feedback.columns)).unionByName(last.select(feedback.columns))


def cap_per_query(feedback: DataFrame, most: int = MAX_PER_QUERY) -> DataFrame:
    """At most ``most`` pairs per query, those voted on last; ties go to the smaller item id."""
    order = Window.partitionBy(KEY).orderBy(F.desc("timestamp_utc"), F.asc(ITEM))
    return latest_votes(feedback).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _rejected_pairs(feedback: DataFrame, least: float, most: float | None) -> DataFrame:
    score = F.col("score_sbert")
    return query_key(feedback).where(~_approved() & ((score > least) if most is None else score.between(least, most)))


def _among_first(rows: DataFrame, queries: DataFrame | None, items: DataFrame | None) -> DataFrame:
    """Pairs within the first ``HARD_RANK``, by the stored rank or by a rank counted over all items."""
    if queries is None:
        near = rows.where(F.col("rank_posicao") <= HARD_RANK)
        return near.groupBy(PAIR).agg(F.max("score_sbert").alias("score"))
    pairs = rows.groupBy(PAIR).agg(F.max("score_sbert").alias("score"))
    path = shared_dir(rows.sparkSession, "rejected-pairs")
    named = queries.select(*KEY, "vector").withColumn("query_id", F.xxhash64(*KEY))
    pairs.withColumn("query_id", F.xxhash64(*KEY)).withColumnRenamed(ITEM, "cd_insumo").write.parquet(path)
    stored = rows.sparkSession.read.parquet(path)
    asked = named.join(stored.select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id").agg(F.min("vector").alias("vector"))
    ranks = rank_pairs(stored, asked, items).where(F.col("knn_rank") <= HARD_RANK)
    return stored.join(ranks, ["query_id", "cd_insumo"]).select(*KEY, F.col("cd_insumo").alias(ITEM), "score", "knn_rank")


def hard_negatives(feedback: DataFrame, queries: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """Rejected pairs that score above 0.7 and stand among the first 30 of their query.

    With ``queries`` (the key columns and ``vector``) and ``items`` (``cd_insumo, vector``) the place of each
    rejected pair is counted anew among all items and given as ``knn_rank``; pairs without both vectors
    are left out.  Without them the rank stored with the vote decides, and votes without one are left out.
    """
    found = _among_first(_rejected_pairs(feedback, HARD_SCORE, None), queries, items)
    return found.withColumns({"weight": F.lit(HARD_WEIGHT), "source": F.lit("hard_negative")})


def semi_hard_negatives(feedback: DataFrame, queries: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """Rejected pairs that score from 0.5 to 0.7 among the first 30 of their query, as in ``hard_negatives``."""
    found = _among_first(_rejected_pairs(feedback, SEMI_HARD_SCORE, HARD_SCORE), queries, items)
    return found.withColumns({"weight": F.lit(1.0), "source": F.lit("semi_hard_negative")})


def eval_report(votes: DataFrame, model: str = "app_version") -> DataFrame:
    """Recall at 1, 5 and 10, mean reciprocal rank, coverage at 10 and score separation per model.

    The rank of a query is the best rank of an approved vote; coverage counts queries with any vote
    among the first ten; separation is the mean final score of approved less that of rejected votes.
    """
    rows = query_key(votes)
    rank, good = F.col("rank_posicao"), _approved()
    queries = rows.groupBy(F.col(model).alias("model"), *KEY).agg(F.min(F.when(good, rank)).alias("rank"), F.min(rank).alias("any_rank"))

    def share(condition: Column) -> Column:
        return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))

    ranked = queries.groupBy("model").agg(
        F.count("*").alias("queries"), *[share(F.col("rank") <= k).alias(f"recall_{k}") for k in (1, 5, 10)],
        F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), share(F.col("any_rank") <= 10).alias("coverage_10"))
    scores = rows.groupBy(F.col(model).alias("model")).agg(
        (F.avg(F.when(good, F.col("score_final"))) - F.avg(F.when(~good, F.col("score_final")))).alias("separation"))
    return ranked.join(scores, "model")


def compare_models(report: DataFrame, base: str, candidate: str) -> DataFrame:
    """Both models side by side, metric by metric, and whether the candidate is accepted.

    It is when recall at 5 gains five points and no share loses more than two.
    """
    metrics = ["recall_1", "recall_5", "recall_10", "mrr", "coverage_10"]
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    long = report.select("model", F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))
    side = long.groupBy("metric").agg(
        F.max(F.when(F.col("model") == base, F.col("value"))).alias("base"),
        F.max(F.when(F.col("model") == candidate, F.col("value"))).alias("candidate"))
    side = side.withColumn("points", F.round(100 * (F.col("candidate") - F.col("base")), 6))
    everything = Window.partitionBy(F.lit(1))  # five rows
    gain = F.max(F.when(F.col("metric") == "recall_5", F.col("points"))).over(everything) >= MIN_GAIN_POINTS
    return side.withColumn("accepted", F.coalesce(gain & (F.min("points").over(everything) >= -MAX_LOSS_POINTS), F.lit(False)))


def training_manifest(feedback: DataFrame) -> DataFrame:
    """What a training set holds: time range, votes, pairs, queries and balance."""
    pairs = query_key(feedback).groupBy(PAIR).agg(
        F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last"), F.count("*").alias("votes"),
        F.count_if(_approved()).alias("approved"))
    queries = pairs.groupBy(KEY).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("votes").alias("votes"), F.sum("approved").alias("approved"),
        F.count("*").alias("pairs"))
    total = queries.agg(F.min("first").alias("first_vote"), F.max("last").alias("last_vote"), F.sum("votes").alias("votes"),
                        F.sum("pairs").alias("pairs"), F.count("*").alias("queries"), F.sum("approved").alias("approved"))
    return total.withColumn("approved_share", F.try_divide(F.col("approved").cast("double"), F.col("votes").cast("double")))


def ab_ranks(votes: DataFrame, variant: str) -> DataFrame:
    """Per variant and stored rank (null where none is): votes, approved votes, and their share of the variant's approved.

    The distribution behind ``ab_summary``'s mean.
    """
    counted = votes.groupBy(F.col(variant).alias("variant"), F.col("rank_posicao").alias("rank")).agg(
        F.count("*").alias("votes"), F.count_if(_approved()).alias("approved"))
    every = counted.groupBy("variant").agg(F.sum("approved").alias("_all"))
    share = F.try_divide(F.lit(100.0) * F.col("approved"), F.col("_all").cast("double"))
    return counted.join(every.withColumnRenamed("variant", "_variant"), F.col("variant").eqNullSafe(F.col("_variant"))).select(
        "variant", "rank", "votes", "approved", share.alias("approved_pct"))


def ab_summary(votes: DataFrame, variant: str) -> DataFrame:
    """Per variant: approval among the first five, mean rank of approved votes, and whether 200 votes are in."""
    top, good = F.coalesce(F.col("rank_posicao") <= 5, F.lit(False)), _approved()
    counted = votes.groupBy(F.col(variant).alias("variant")).agg(
        F.count("*").alias("votes"), F.count_if(top).alias("top5"), F.count_if(top & good).alias("top5_approved"),
        F.avg(F.when(good, F.col("rank_posicao"))).alias("approved_rank"))
    percent = F.try_divide(F.lit(100.0) * F.col("top5_approved"), F.col("top5").cast("double"))
    return counted.withColumns({"approved_pct": percent, "enough": F.col("votes") >= AB_MIN_VOTES})


def retrain_trigger(feedback: DataFrame, trained_until: Column, rows: int = RETRAIN_ROWS) -> DataFrame:
    """Votes since the last training, and whether they are enough for another."""
    return feedback.agg(F.count_if(F.col("timestamp_utc") > trained_until).alias("new_votes")).withColumn(
        "retrain", F.col("new_votes") >= rows)


def rejects_top3_trend(feedback: DataFrame, period: str = "day") -> DataFrame:
    """Per period the votes among the first three ranks and the share of them rejected."""
    top = feedback.where("rank_posicao <= 3").groupBy(F.date_trunc(period, "timestamp_utc").alias("period")).agg(
        F.count("*").alias("votes"), F.count_if(~_approved()).alias("rejected"))
    return top.withColumn("rejected_share", F.col("rejected") / F.col("votes"))


def vocab_drift(feedback: DataFrame, catalog: DataFrame, column: str, least: int = 3) -> DataFrame:
    """Words that queries use ``least`` times or more and no catalog text holds."""
    asked = query_key(feedback).select(F.explode(words(F.col("key_descricao"))).alias("word")).groupBy("word").agg(
        F.count("*").alias("uses")).where(F.col("uses") >= least)
    known = catalog.select(F.explode(words(F.upper(F.coalesce(column, F.lit(""))))).alias("word")).distinct()
    return asked.join(known, "word", "left_anti")


def _session_votes(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    votes = latest_votes(feedback, [*PAIR, "session_id"]).where("session_id is not null").select(
        *PAIR, "session_id", _approved().cast("long").alias("yes"))
    return votes, votes.groupBy(PAIR).agg(F.count("*").alias("sessions"), F.sum("yes").alias("approved"))


def annotator_agreement(feedback: DataFrame) -> DataFrame:
    """How often a session agrees with the other sessions on the pairs they share.

    Counted from the totals of each pair: a pair that many sessions vote on is not spelled out as
    pairs of sessions.
    """
    votes, totals = _session_votes(feedback)
    same = F.when(F.col("yes") == 1, F.col("approved")).otherwise(F.col("sessions") - F.col("approved")) - 1
    shared = votes.join(totals.where("sessions > 1"), PAIR).groupBy("session_id").agg(
        F.count("*").alias("pairs"), F.sum(F.col("sessions") - 1).alias("compared"), F.sum(same).alias("agreed"))
    return shared.withColumn("agreement", F.col("agreed") / F.col("compared"))


def annotator_weights(feedback: DataFrame) -> DataFrame:
    """Share of a session's votes that agree with the majority; ties are left out."""
    votes, totals = _session_votes(feedback)
    decided = totals.where("2 * approved <> sessions").select(*PAIR, (2 * F.col("approved") > F.col("sessions")).cast("long").alias("most"))
    return votes.join(decided, PAIR).groupBy("session_id").agg(
        F.count("*").alias("votes"), F.avg((F.col("yes") == F.col("most")).cast("double")).alias("weight"))
