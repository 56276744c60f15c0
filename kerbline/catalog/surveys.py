"""Votes, tallies, survey documents, study analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog.common import TALLY, VOTES, r6, table, votes
from kerbline.functions import distributions as D
from kerbline.functions.constants import AIDS
from kerbline.operators import study, votes as V
from kerbline.operators.metrics import wilson
from kerbline.operators.tally import class_distribution, entropy_histogram, tally


def _rounded(t):
    return t.select("image_id", "aid", "no", "unsure", "yes", "total_votes", *(r6(c) for c in ("p_no", "p_unsure", "p_yes", "entropy", "margin")), "is_uncertain", "argmax_label", "label_name", "label", r6("sample_weight"))


def _tally_sql(label: str, where: str = "", weight: str = "1 - least(greatest(entropy / ln(3), 0), 1)", number: str | None = None) -> str:
    number = number or "CASE label_name WHEN 'no' THEN 0 WHEN 'unsure' THEN 1 WHEN 'yes' THEN 2 END"
    return f"""WITH {VOTES}, {TALLY}, named AS (SELECT *, {label} AS label_name FROM tallies {where})
SELECT image_id, aid, "no", unsure, yes, total_votes, round(p_no, 6) AS p_no, round(p_unsure, 6) AS p_unsure, round(p_yes, 6) AS p_yes, round(entropy, 6) AS entropy,
  round(margin, 6) AS margin, is_uncertain, argmax_label, label_name, ({number})::INT AS label, round({weight}, 6) AS sample_weight FROM named"""


def survey_documents(spark, sf_dir):
    """Events as nested survey documents, one a user, aid and group, in typed wrappers."""
    v = votes(spark, sf_dir)
    text = lambda c: F.struct(c.cast("string").alias("stringValue"))
    whole = lambda c: F.struct(c.cast("string").alias("integerValue"))
    entry = F.struct(F.struct(F.struct(whole(F.col("image_id") + 1).alias("LabelID"), whole(F.col("image_id") % 8).alias("LabelTypeID")).alias("fields")).alias("mapValue"))
    side = lambda c: F.struct(F.struct(F.collect_list(F.when(c, entry)).alias("values")).alias("arrayValue"))
    aid = F.array(*(F.lit(a.upper()) for a in [*AIDS, "skateboard"]))[(F.col("pid") % 6).cast("int")]
    sides = v.groupBy("pid", (F.col("image_id") % 9).alias("g")).agg(side(F.col("value") >= 20.5).alias("a"), side(F.col("value") < 55.1).alias("b"))
    named = sides.select("pid", "g", aid.alias("aid"), F.map_from_arrays(F.array(F.concat(F.lit("group"), "g", F.lit("A")), F.concat(F.lit("group"), "g", F.lit("B"))), F.array("a", "b")).alias("sides"))
    group = F.map_from_arrays(F.array(F.concat(F.lit("group"), "g")), F.array(F.struct(F.struct(F.col("sides").alias("fields")).alias("mapValue"))))
    doc = F.struct(
        F.concat(F.lit("x/y/"), "pid").alias("name"),
        F.struct(text(F.col("pid")).alias("userId"), text(F.col("aid")).alias("mobilityAid"), text(F.lit("Final")).alias("logType"), F.struct(F.struct(group.alias("fields")).alias("mapValue")).alias("imageSelections")).alias("fields"),
    )
    return named.select(F.struct("pid", "g").alias("ordinal"), F.try_parse_json(F.to_json(doc)).alias("doc"))


def survey_to_votes(spark, sf_dir):
    return V.survey_votes(survey_documents(spark, sf_dir), keep_log_types=["final"]).select("pid", "aid", "image_set", "image_id", "image_type", "selection")


def dedup_keep_first(spark, sf_dir):
    return V.keep_first(votes(spark, sf_dir), ["pid", "aid", "image_id"], "event_id").select("event_id", "pid", "aid", "image_id", "selection")


def merge_existing(spark, sf_dir):
    v = votes(spark, sf_dir).select("event_id", "pid", "aid", "image_id")
    return V.merge_existing(v.where("event_id % 3 = 0"), v.where("event_id % 3 <> 0"), ["pid", "aid", "image_id"])


def vote_counts(spark, sf_dir):
    return V.count_by(votes(spark, sf_dir), "aid", "selection")


def distinct_counts(spark, sf_dir):
    return votes(spark, sf_dir).agg(F.countDistinct("pid").alias("participants"), F.countDistinct("image_id", "aid").alias("pairs"))


def entropy_variants(spark, sf_dir):
    t = tally(votes(spark, sf_dir))
    p = F.array("p_no", "p_unsure", "p_yes")
    return t.select("image_id", "aid", r6(D.normalised_entropy(p), "clipped"), r6(D.normalised_entropy(p, 1e-9, None), "clipped_small"), r6(D.renormalised_entropy(p), "renormalised"), D.confidence(F.col("entropy")).alias("confidence"))


def histogram(spark, sf_dir):
    return entropy_histogram(tally(votes(spark, sf_dir)))


def submissions(spark, sf_dir):
    """Users as study sessions with nested trials."""
    v = votes(spark, sf_dir)
    image = F.struct(F.col("image_id"), F.col("selection").alias("response"), (F.col("event_id") % 7 == 0).alias("skipped"), (F.col("value") * 100).cast("long").alias("response_time_ms"))
    route = F.struct((F.col("event_id") % 10).alias("route_pair_id"), F.array(F.lit("route_a"), F.lit("route_b"), F.lit("neither"))[(F.col("event_id") % 3).cast("int")].alias("selected_route"), F.array(F.lit("accessible"), F.lit("standard"))[(F.col("event_id") % 2).cast("int")].alias("route_a_type"), F.array(F.lit("standard"), F.lit("accessible"))[(F.col("event_id") % 2).cast("int")].alias("route_b_type"), (F.col("event_id") % 5 == 0).alias("skipped"))
    scores = F.create_map(F.lit("q1"), F.when(F.col("pid") % 4 != 0, F.col("pid") % 5), F.lit("q2"), F.col("pid") % 3)
    return v.groupBy("pid").agg(F.min("aid").alias("aid"), F.collect_list(image).alias("image_trials"), F.collect_list(route).alias("route_trials")).select(F.col("pid").alias("session_id"), "aid", "image_trials", "route_trials", scores.alias("usability"))


def study_yes_rates(spark, sf_dir):
    trials = spark.range(50).select(F.col("id").alias("image_id"), (F.col("id") / 100).alias("model_p_yes"), F.lit("x").alias("given_class"), F.create_map(F.lit("click"), F.col("id") / 50).alias("per_aid_p_yes"))
    return study.yes_rates(study.image_responses(submissions(spark, sf_dir), trials)).select("image_id", "aid", "n", r6("yes_rate"), r6("model_p_yes"))


def study_preferences(spark, sf_dir):
    rows = submissions(spark, sf_dir).select("aid", F.explode("route_trials").alias("t")).where("not t.skipped")
    rows = rows.select("aid", study.preferred_accessible(F.col("t.selected_route"), F.col("t.route_a_type"), F.col("t.route_b_type")).alias("preferred_accessible"))
    return study.route_preferences(rows, ["aid"]).select("aid", "n", "k", r6("share"), r6("low"), r6("high"))


def study_participants(spark, sf_dir):
    return study.participants(submissions(spark, sf_dir))


def study_usability(spark, sf_dir):
    return study.usability(submissions(spark, sf_dir)).select("question", "n", r6("mean"))


def wilson_intervals(spark, sf_dir):
    got = votes(spark, sf_dir).groupBy("aid", "image_id").agg(F.count_if(F.col("selection") == "yes").alias("k"), F.count("*").alias("n"))
    return got.withColumn("ci", wilson(F.col("k"), F.col("n"))).select("aid", "image_id", "k", "n", r6(F.col("ci.low"), "low"), r6(F.col("ci.high"), "high"))


QUERIES = {
    "tally_soft_labels": lambda s, d: _rounded(tally(votes(s, d))),
    "tally_hard_drop": lambda s, d: _rounded(tally(votes(s, d), target="hard_drop", weight="votes")),
    "tally_soft": lambda s, d: _rounded(tally(votes(s, d), target="soft")),
    "tally_compat": lambda s, d: _rounded(tally(votes(s, d), compat=True)),
    "survey_to_votes": survey_to_votes,
    "dedup_keep_first": dedup_keep_first,
    "merge_existing": merge_existing,
    "vote_counts": vote_counts,
    "distinct_counts": distinct_counts,
    "entropy_variants": entropy_variants,
    "entropy_histogram": histogram,
    "class_distribution": lambda s, d: class_distribution(tally(votes(s, d))),
    "study_yes_rates": study_yes_rates,
    "study_preferences": study_preferences,
    "study_participants": study_participants,
    "study_usability": study_usability,
    "wilson_intervals": wilson_intervals,
}

_RELABEL = "CASE WHEN is_uncertain THEN 'unsure' ELSE best END"
_WILSON = """round(greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
  round(least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS high"""
_FIRST = "SELECT *, min(aid) OVER (PARTITION BY pid) AS own FROM votes"

SQL = {
    "tally_soft_labels": _tally_sql(_RELABEL),
    "tally_hard_drop": _tally_sql("best", "WHERE NOT is_uncertain", "1.0::DOUBLE"),
    "tally_soft": _tally_sql("NULL::VARCHAR"),
    "tally_compat": _tally_sql(_RELABEL, number="CASE WHEN is_uncertain THEN 1 END"),
    "survey_to_votes": f"""WITH {VOTES}, s AS (SELECT pid, image_id, bool_or(value >= 20.5) AS a, bool_or(value < 55.1) AS b FROM votes WHERE pid % 6 <> 5 GROUP BY pid, image_id)
SELECT pid::VARCHAR AS pid, (['Walking cane','Walker','Mobility scooter','Manual wheelchair','Motorized wheelchair'])[(pid % 6 + 1)::INT] AS aid, (image_id % 9)::INT AS image_set, image_id + 1 AS image_id,
  CASE image_id % 8 WHEN 0 THEN 'Unknown' ELSE (['CurbRamp','NoCurbRamp','Obstacle','SurfaceProblem','NoSidewalk','Crosswalk','Signal'])[(image_id % 8)::INT] END AS image_type,
  CASE WHEN a AND b THEN 'Unsure' WHEN a THEN 'Yes' ELSE 'No' END AS selection FROM s""",
    "dedup_keep_first": f"WITH {VOTES} SELECT min(event_id) AS event_id, pid, aid, image_id, arg_min(selection, event_id) AS selection FROM votes GROUP BY pid, aid, image_id",
    "merge_existing": f"""WITH {VOTES} SELECT event_id, pid, aid, image_id FROM votes WHERE event_id % 3 = 0 UNION ALL
SELECT event_id, pid, aid, image_id FROM votes v WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM votes e WHERE e.event_id % 3 = 0 AND e.pid = v.pid AND e.aid = v.aid AND e.image_id = v.image_id)""",
    "vote_counts": f"WITH {VOTES} SELECT aid, selection, count(*) AS n FROM votes GROUP BY aid, selection",
    "distinct_counts": f"WITH {VOTES} SELECT count(DISTINCT pid) AS participants, count(DISTINCT (image_id, aid)) AS pairs FROM votes",
    "entropy_variants": f"""WITH {VOTES}, {TALLY}, c AS (SELECT *, greatest(p_no, 1e-12) a, greatest(p_unsure, 1e-12) b, greatest(p_yes, 1e-12) c, greatest(p_no, 1e-9) d, greatest(p_unsure, 1e-9) e, greatest(p_yes, 1e-9) f,
  (p_no + 1e-9) / (1 + 3e-9) g, (p_unsure + 1e-9) / (1 + 3e-9) h, (p_yes + 1e-9) / (1 + 3e-9) i FROM tallies)
SELECT image_id, aid, round(-(a * ln(a) + b * ln(b) + c * ln(c)) / ln(3), 6) AS clipped, round(-(d * ln(d) + e * ln(e) + f * ln(f)) / ln(3), 6) AS clipped_small,
  round(-(g * ln(g) + h * ln(h) + i * ln(i)) / ln(3), 6) AS renormalised, CASE WHEN entropy < 0.5 THEN 'high' WHEN entropy < 0.9 THEN 'medium' ELSE 'low' END AS confidence FROM c""",
    "entropy_histogram": f"""WITH {VOTES}, {TALLY}, c AS (SELECT aid, (p_no + 1e-9) / (1 + 3e-9) g, (p_unsure + 1e-9) / (1 + 3e-9) h, (p_yes + 1e-9) / (1 + 3e-9) i FROM tallies)
SELECT aid, least(greatest(floor(-(g * ln(g) + h * ln(h) + i * ln(i)) / ln(3) * 12), 0), 11)::INT AS bin, count(*) AS n FROM c GROUP BY 1, 2""",
    "class_distribution": f"WITH {VOTES}, {TALLY} SELECT aid, count(*) FILTER (best = 'no') AS n_no, count(*) FILTER (best = 'unsure') AS n_unsure, count(*) FILTER (best = 'yes') AS n_yes, count(*) AS n FROM tallies GROUP BY aid",
    "study_yes_rates": f"""WITH {VOTES}, o AS ({_FIRST}) SELECT image_id, own AS aid, count(*) AS n, round(avg(CASE WHEN selection = 'yes' THEN 1.0 ELSE 0 END), 6) AS yes_rate,
  round(min(CASE WHEN image_id >= 50 THEN NULL WHEN own = 'click' THEN image_id / 50 ELSE image_id / 100 END), 6) AS model_p_yes FROM o WHERE event_id % 7 <> 0 GROUP BY 1, 2""",
    "study_preferences": f"""WITH {VOTES}, o AS ({_FIRST}), g AS (SELECT own AS aid, count(*) AS n, count(*) FILTER ((event_id % 3 = 0) = (event_id % 2 = 0)) AS k FROM o WHERE event_id % 5 <> 0 AND event_id % 3 < 2 GROUP BY own),
q AS (SELECT *, k / n AS p FROM g) SELECT aid, n, k, round(p, 6) AS share, {_WILSON} FROM q""",
    "study_participants": f"""WITH {VOTES} SELECT pid AS session_id, count(*) FILTER (event_id % 7 <> 0)::INT AS n_image_trials, count(*) FILTER (event_id % 7 = 0)::INT AS skipped_image_trials,
  count(*) FILTER (event_id % 5 <> 0)::INT AS n_route_trials, count(*) FILTER (event_id % 5 = 0)::INT AS skipped_route_trials FROM votes GROUP BY pid""",
    "study_usability": f"""WITH {VOTES}, p AS (SELECT DISTINCT pid FROM votes) SELECT 'q1' AS question, count(*) AS n, round(avg(pid % 5), 6) AS mean FROM p WHERE pid % 4 <> 0
UNION ALL SELECT 'q2', count(*), round(avg(pid % 3), 6) FROM p""",
    "wilson_intervals": f"""WITH {VOTES}, g AS (SELECT aid, image_id, count(*) FILTER (selection = 'yes') AS k, count(*) AS n FROM votes GROUP BY 1, 2), q AS (SELECT *, k / n AS p FROM g)
SELECT aid, image_id, k, n, {_WILSON} FROM q""",
}
