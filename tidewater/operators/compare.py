"""Which sets may be compared, and how they compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calibration import folded
from .metrics import difference, difference_over_lower, winner

#: Fixed: metadata that two sets must have and share, and metadata that must not differ where both have it.
STRICT_FIELDS = ("participant_id", "muscle", "side", "exercise_name", "weight")
OPTIONAL_FIELDS = ("source_type", "test_type", "set_end_rule", "comparison_target")
#: What is compared of two sets, by its name in :func:`~tidewater.operators.metrics.set_metrics`.
RAW_COMPARED = ("mean_activation", "median_activation", "peak_activation", "total_integral", "active_time", "mean_duration", "duration_variation", "change", "slope")
NORM_COMPARED = ("norm_mean_activation", "norm_median_activation", "norm_peak_activation", "norm_integral", "norm_change", "norm_slope")
FATIGUE_SHOWN = 5


def newest_pair(workouts: DataFrame) -> DataFrame:
    """Per participant, the newest two workouts that agree on muscle, side and weight; the last two where none agree.

    Muscle and side have to be the same text, an empty weight agrees with any.
    Among pairs, the newer workout decides first, then the older.  The best
    partner of a workout is the next older one of its key with its weight, or
    with none, or just the next if it has none itself: three windows, no pairs.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c)
    rank = F.row_number().over(Window.partitionBy("participant_id").orderBy(F.desc("mtime"), "recording_id"))
    r = workouts.select("participant_id", "recording_id", text("muscle"), text("side"), text("weight"), rank.alias("rk"))
    me = F.struct("rk", "recording_id")
    key = Window.partitionBy("participant_id", "muscle", "side").orderBy(F.desc("rk"))
    same_weight = F.lag(me).over(Window.partitionBy("participant_id", "muscle", "side", "weight").orderBy(F.desc("rk")))
    without = F.last(F.when(F.col("weight") == "", me), ignorenulls=True).over(key.rowsBetween(Window.unboundedPreceding, -1))
    partner = F.when(F.col("weight") == "", F.lag(me).over(key)).otherwise(F.least(same_weight, without))
    pairs = r.withColumn("older", partner)
    last = F.max_by("recording_id", F.when(F.col("rk") == 1, 1)), F.max_by("recording_id", F.when(F.col("rk") == 2, 1))
    found = F.min(F.when(F.col("older").isNotNull(), F.struct("rk", "recording_id", "older")))
    best = pairs.groupBy("participant_id").agg(found.alias("p"), last[0].alias("first"), last[1].alias("second")).filter("second is not null")
    return best.select(
        "participant_id", F.coalesce("p.recording_id", "first").alias("newer"), F.coalesce("p.older.recording_id", "second").alias("older"), F.col("p").isNotNull().alias("compatible"))


def previous_compatible(recordings: DataFrame) -> DataFrame:
    """The newest other recording with the same exercise, side and weight; it need not be older.

    Only the two newest of each key can be anybody's answer, so the join meets at
    most two rows a recording, however many share the key.
    """
    keys = [folded(F.col(c)).alias(f"_{c}") for c in ("exercise", "side", "weight")]
    r = recordings.select("recording_id", "mtime", *keys)
    names = ["_exercise", "_side", "_weight"]
    ends = r.groupBy(*names).agg(F.max(F.struct("mtime", "recording_id")).alias("first"))
    second = r.join(ends, names).filter(F.col("recording_id") != F.col("first.recording_id")).groupBy(*names).agg(F.max(F.struct("mtime", "recording_id")).alias("second"))
    both = r.join(ends, names).join(second, names, "left")
    other = F.when(F.col("first.recording_id") != F.col("recording_id"), F.col("first.recording_id")).otherwise(F.col("second.recording_id"))
    return both.select("recording_id", other.alias("previous_id"))


def side_by_side(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...], missing: bool = False) -> DataFrame:
    """``pairs`` (``newer, older``) with the ``columns`` of both sets as ``a_`` and ``b_``; pairs that lack one go, unless ``missing``.

    Both sets of a pair are looked up in one join, so ``sets`` is computed once.
    """
    own = [c for c in pairs.columns]
    sides = pairs.withColumn("_side", F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("newer").alias("recording_id")), F.struct(F.lit("b").alias("s"), F.col("older").alias("recording_id")))))
    found = sides.select(F.struct(*own).alias("_pair"), F.col("_side.s").alias("_s"), F.col("_side.recording_id").alias("recording_id")).join(sets.select("recording_id", F.struct(*columns).alias("_set")), "recording_id", "left" if missing else "inner")
    of = lambda s: F.max(F.when(F.col("_s") == s, F.struct(F.lit(1).alias("_there"), F.col("_set").alias("v"))))
    both = found.groupBy("_pair").agg(of("a").alias("_a"), of("b").alias("_b"))
    both = both if missing else both.filter("_a is not null and _b is not null")
    return both.select("_pair.*", *[F.col(f"_{s}.v.{c}").alias(f"{s}_{c}") for s in "ab" for c in columns])


def metadata_warnings(pairs: DataFrame) -> DataFrame:
    """Warnings on pairs with columns ``a_<field>`` and ``b_<field>``; a column that is not there counts as empty.

    Strict fields must be there and equal, optional ones equal if both are there.
    """
    def clean(side: str, c: str) -> Column:
        return F.trim(F.coalesce(F.col(f"{side}_{c}").cast("string"), F.lit(""))) if f"{side}_{c}" in pairs.columns else F.lit("")

    said = []
    for c in STRICT_FIELDS + OPTIONAL_FIELDS:
        a, b = clean("a", c), clean("b", c)
        differs = F.concat(F.lit(f"{c} differs: "), a, F.lit(" / "), b)
        said.append(F.when((a == "") | (b == ""), f"{c} missing" if c in STRICT_FIELDS else None).when(a != b, differs))
    out = pairs.withColumn("warnings", F.array_join(F.array_compact(F.array(*said)), "; "))
    return out.withColumn("compatible_metadata", F.col("warnings") == "")


def metric_differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``newer, older, metric, a, b, delta, percent`` for every metric of two sets; normalised ones only where ``allowed`` (see :func:`normalised_gate`) is true."""
    columns = (*RAW_COMPARED, *(c for c in NORM_COMPARED if c in sets.columns))
    j = side_by_side(pairs, sets, columns)
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.lit(c in NORM_COMPARED).alias("norm"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns])
    long = j.select("newer", "older", F.coalesce("allowed", F.lit(False)).alias("allowed") if "allowed" in j.columns else F.lit(False).alias("allowed"), F.explode(rows).alias("m")).filter("allowed or not m.norm")
    a, b = F.col("m.a"), F.col("m.b")
    return long.select("newer", "older", "m.metric", a.alias("a"), b.alias("b"), F.round(b - a, 6).alias("delta"), F.round(difference(a, b), 6).alias("percent"))


def compare_pairs(pairs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Counts, means and winners of each pair ``newer, older`` of summarised sets."""
    cols = ("rep_count", "avg_value", "avg_peak", "highest_peak", "peak_drop", "set_duration")
    return compared(side_by_side(pairs, summaries, cols)).select("newer", "older", "newer_reps", "older_reps", "higher_activation", "higher_peak", "more_fatigue", "activation_difference", "peak_difference")


def compared(both: DataFrame) -> DataFrame:
    """Pairs with both sets' summaries (:func:`side_by_side`) and the comparison's columns."""
    fatigue = F.when(F.greatest("a_peak_drop", "b_peak_drop") <= FATIGUE_SHOWN, "Neither").otherwise(winner(F.col("a_peak_drop"), F.col("b_peak_drop")))
    return both.withColumns({
        "newer_reps": F.col("a_rep_count"), "older_reps": F.col("b_rep_count"), "higher_activation": winner(F.col("a_avg_value"), F.col("b_avg_value")), "higher_peak": winner(F.col("a_highest_peak"), F.col("b_highest_peak")), "more_fatigue": fatigue,
        "activation_difference": F.round(difference(F.col("a_avg_value"), F.col("b_avg_value")), 6), "peak_difference": F.round(difference_over_lower(F.col("a_avg_peak"), F.col("b_avg_peak")), 6)})


def matched_reps(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Both sets of a pair cut to the number of repetitions of the shorter one, and how they compare then; pairs of equal counts give none.

    ``matched_reps``; per set the means of peaks and means (``a_``, ``b_``) and the
    fall of the peak from the first half to the second in percent; winners, the
    percents by which peaks and means differ over the lower, and which set tires more.
    """
    counts = metrics.groupBy("recording_id").agg(F.max("rep_no").alias("n"))
    c = side_by_side(pairs.select("newer", "older"), counts, ("n",)).filter("a_n != b_n").withColumn("m", F.least("a_n", "b_n"))
    sides = c.select("newer", "older", "m", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("newer").alias("recording_id")), F.struct(F.lit("b").alias("side"), F.col("older").alias("recording_id")))).alias("s")).select("newer", "older", "m", "s.side", "s.recording_id")
    mean = lambda x: F.round(F.sum(x), 6) / F.count(x)
    first = F.col("rep_no") <= F.floor(F.col("m") / 2)
    cut = sides.join(metrics, "recording_id").filter("rep_no <= m").groupBy("newer", "older", "m", "side").agg(
        mean("peak_value").alias("avg_peak"), mean("mean_value").alias("avg_value"), mean(F.when(first, F.col("peak_value"))).alias("_first"), mean(F.when(~first, F.col("peak_value"))).alias("_second"))
    cut = cut.withColumn("peak_drop", F.coalesce(F.when(F.col("_first") > 0, (F.col("_first") - F.col("_second")) / F.col("_first") * 100), F.lit(0.0)))
    names = ("avg_peak", "avg_value", "peak_drop")
    of = [F.max(F.when(F.col("side") == s, F.col(x))).alias(f"{s}_{x}") for s in "ab" for x in names]
    g = cut.groupBy("newer", "older", F.col("m").alias("matched_reps")).agg(*of)
    a, b = ({x: F.col(f"{s}_{x}") for x in names} for s in "ab")
    fatigue = F.when(F.greatest(a["peak_drop"], b["peak_drop"]) <= FATIGUE_SHOWN, "Neither").otherwise(winner(a["peak_drop"], b["peak_drop"]))
    return g.select(
        "newer", "older", "matched_reps", *[F.round(F.col(f"{s}_{x}"), 6).alias(f"{s}_{x}") for s in "ab" for x in names], winner(a["avg_value"], b["avg_value"]).alias("matched_activation"), winner(a["avg_peak"], b["avg_peak"]).alias("matched_peak"), fatigue.alias("matched_fatigue"),
        F.round(difference_over_lower(a["avg_value"], b["avg_value"]), 6).alias("matched_difference"), F.round(difference_over_lower(a["avg_peak"], b["avg_peak"]), 6).alias("matched_peak_difference"), F.round(F.abs(a["peak_drop"] - b["peak_drop"]), 6).alias("matched_fatigue_points"))


#: Fixed: a change of activation that still counts as steady, differences that are worth a word, an activation that asks for another calibration.
STEADY, NOTABLE_PERCENT, NOTABLE_POINTS, TOO_HIGH = 5.0, 5.0, 5.0, 110.0


def normalised_gate(pairs: DataFrame) -> DataFrame:
    """Whether the normalised values of two sets may be compared: ``allowed``, ``exploratory`` and ``gate``, the reason.

    Columns ``a_`` and ``b_``: ``usable``, ``cross_session``, ``side``,
    ``calibration_side``, ``signature``; and ``compatible_metadata``.  Sets of
    two sides are compared on trial only, and not if a calibration is of the
    other side; sets of one side need the same calibration and no warning about
    their metadata.
    """
    yes = lambda c: F.coalesce(F.col(f"a_{c}") & F.col(f"b_{c}"), F.lit(False))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    apart = (text("a_side") != "") & (text("b_side") != "") & (text("a_side") != text("b_side"))
    other = lambda s: (text(f"{s}_calibration_side") != "") & (text(f"{s}_calibration_side") != text(f"{s}_side"))
    gate = (
        F.when(~yes("usable"), "no usable calibration").when(~yes("cross_session"), "calibration too poor")
        .when(apart, F.when(other("a") | other("b"), "calibration of the other side").otherwise("sides on trial"))
        .when(~F.col("a_signature").eqNullSafe(F.col("b_signature")), "different calibrations").when(~F.coalesce("compatible_metadata", F.lit(False)), "metadata differs").otherwise("ok")
    )
    reached = yes("usable") & yes("cross_session") & apart
    return pairs.withColumn("gate", gate).withColumns({"allowed": F.col("gate").isin("ok", "sides on trial"), "exploratory": reached})


def trend(drop: Column) -> Column:
    """What activation does over a set, from its fall in percent."""
    return F.when(F.abs(drop) <= STEADY, "steady").when(drop > 0, "falling").otherwise("rising")


def trends(pairs: DataFrame, a: str = "a_peak_drop", b: str = "b_peak_drop") -> DataFrame:
    """``trend``: how the activation of two sets changes, as ``both steady``, one steady and one not, opposite, or alike with the stronger one named."""
    x, y = F.col(a), F.col(b)
    gap = F.abs(F.abs(x) - F.abs(y))
    size = lambda c: F.format_string("%.1f%%", F.abs(c))
    strongest = F.when(gap == 0, "alike").otherwise(F.concat(winner(F.abs(x), F.abs(y)), F.when(gap >= NOTABLE_POINTS, " clearly more").otherwise(" slightly more")))
    one = lambda name, c: F.concat(F.lit(f"{name} "), trend(c), F.when(trend(c) != "steady", F.concat(F.lit(" by "), size(c))).otherwise(""))
    mixed = F.concat_ws(", ", one("Set 1", x), one("Set 2", y))
    opposite = F.concat_ws(", ", F.concat(F.lit("Set 1 "), trend(x)), F.concat(F.lit("Set 2 "), trend(y)))
    said = (
        F.when((trend(x) == "steady") & (trend(y) == "steady"), "both steady").when((trend(x) == "steady") | (trend(y) == "steady"), mixed)
        .when(trend(x) != trend(y), opposite).otherwise(F.concat(F.lit("both "), trend(x), F.lit(": "), strongest))
    )
    return pairs.withColumn("trend", said)


def insights(pairs: DataFrame) -> DataFrame:
    """``insights``: short remarks on compared sets, in a fixed order.

    Columns: those of :func:`compare_pairs`, ``trend``, and, null where there is
    none, ``normalised_activation`` and ``normalised_difference`` (winner and
    percent), the same of peaks, ``matched_reps``, ``matched_activation`` and
    ``matched_difference``.  Calibrated values speak before raw ones.
    """
    def remark(what: str, who: Column, percent: Column) -> Column:
        same = (F.coalesce(percent, F.lit(0.0)) < NOTABLE_PERCENT) | (who == "Tie")
        return F.concat(F.lit(f"{what}: "), F.when(same, "about the same").otherwise(F.concat(who, F.lit(" higher"))))

    calibrated = F.col("normalised_activation").isNotNull()
    activation = F.when(calibrated, remark("calibrated activation", F.col("normalised_activation"), F.col("normalised_difference"))).otherwise(remark("activation", F.col("higher_activation"), F.col("activation_difference")))
    reps = F.concat(F.lit("repetitions: "), F.when(F.col("newer_reps") == F.col("older_reps"), "equal").when(F.col("newer_reps") > F.col("older_reps"), "Set 1 more").otherwise("Set 2 more"))
    matched = F.when(F.col("matched_reps").isNotNull(), F.concat(F.lit("first "), F.col("matched_reps").cast("string"), F.lit(" of each, "), remark("activation", F.col("matched_activation"), F.col("matched_difference"))))
    peak = remark("peak", F.coalesce("normalised_peak", "higher_peak"), F.coalesce("normalised_peak_difference", "peak_difference"))
    return pairs.withColumn("insights", F.array_compact(F.array(activation, F.col("trend"), reps, matched, peak)))


def agreement(threshold_reps: DataFrame, valley_reps: DataFrame, recordings: DataFrame) -> DataFrame:
    """Counts of both detectors next to what was expected (``expected_reps``, a text), whether they agree with each other and with it, and their intervals as text.

    An expectation that is unknown or empty differs from nothing.
    """
    sides = [reps.select("recording_id", F.lit(name).alias("by"), "start_time", "end_time") for reps, name in ((threshold_reps, "threshold"), (valley_reps, "valley"))]
    return agreement_of(sides[0].unionByName(sides[1]).repartition("recording_id"), recordings)


def agreement_of(reps: DataFrame, recordings: DataFrame) -> DataFrame:
    """:func:`agreement` of repetitions that are told apart by ``by``, ``threshold`` or ``valley``."""
    def side(name: str) -> list[Column]:
        own = F.when(F.col("by") == name, F.struct("start_time", "end_time"))
        shown = F.transform(F.sort_array(F.collect_list(own)), lambda x: F.concat_ws("-", F.round(x["start_time"], 2).cast("decimal(18,2)").cast("string"), F.round(x["end_time"], 2).cast("decimal(18,2)").cast("string")))
        return [F.count(own).alias(f"{name}_reps"), F.array_join(shown, ", ").alias(f"{name}_intervals")]

    both = reps.groupBy("recording_id").agg(*side("threshold"), *side("valley"))
    j = recordings.select("recording_id", "expected_reps").join(both, "recording_id", "left")
    count = lambda n: F.coalesce(f"{n}_reps", F.lit(0)).cast("long").alias(f"{n}_reps")
    j = j.select("recording_id", "expected_reps", count("threshold"), count("valley"), *[F.coalesce(f"{n}_intervals", F.lit("")).alias(f"{n}_intervals") for n in ("threshold", "valley")])
    said = F.trim(F.coalesce("expected_reps", F.lit("")))
    met = lambda n: (said == "") | (said == F.col(n).cast("string"))
    return j.withColumns({"agree": F.col("threshold_reps") == F.col("valley_reps"), "threshold_as_expected": met("threshold_reps"), "valley_as_expected": met("valley_reps")})


def normalised_block(pairs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Winners and percents of two calibrated sets' normalised values (``norm_avg_value``, ``norm_peak``; null without calibration); null unless both are calibrated."""
    cols = ("norm_avg_value", "norm_peak")
    j = side_by_side(pairs, summaries, cols, missing=True)
    both = F.col("a_norm_avg_value").isNotNull() & F.col("b_norm_avg_value").isNotNull()
    out = {}
    for c, who, percent in (("norm_avg_value", "normalised_activation", "normalised_difference"), ("norm_peak", "normalised_peak", "normalised_peak_difference")):
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        out |= {who: F.when(both, winner(a, b)), percent: F.when(both, F.round(difference_over_lower(a, b), 6))}
    return j.withColumns(out).drop(*[f"{p}_{c}" for p in "ab" for c in cols])
