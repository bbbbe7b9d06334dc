"""Seek planning: where decoding must start to show a time, and how much it must read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.asof import as_of, prefix_max


def shown_from(pts: Column, target: Column) -> Column:
    """Whether a frame is shown after a seek: without a target or a time it is."""
    return target.isNull() | pts.isNull() | (pts >= target)


def may_skip(pts: Column, target: Column, is_reference: Column) -> Column:
    """Whether a picture need not be rebuilt: no reference, and certainly before the target."""
    return ~is_reference & F.coalesce(pts < target, F.lit(False))


def choose_source(keyframe: Column, checkpoint: Column, forward: Column) -> Column:
    """Forward from the cursor if it is not behind the best restart; else the checkpoint if it is past the keyframe."""
    best = F.greatest(keyframe, F.coalesce(checkpoint, keyframe))
    return F.when(forward >= best, "Forward").when(checkpoint > keyframe, "Checkpoint").otherwise("Keyframe")


def seek_mode(required: Column, budget: Column) -> Column:
    """What an interactive seek does: "Exact" up to the budget of samples, beyond it a "Preview" of the nearest keyframe.

    Without a plan there is no mode; without a budget every plan is exact.
    """
    return F.when(required > budget, "Preview").when(required.isNotNull(), "Exact")


def seek_plan(targets: DataFrame, samples: DataFrame, track: list[str], bucket: int | None = None) -> DataFrame:
    """targets (track, target) with keyframe_index, selected_index and required.

    samples: track, sample_index (decode order), pts, sync. Decoding starts at
    the last sync sample at or before the target, ties to the least index. The
    selected sample is the first by (pts, index) at or after the target before
    or at the next sync sample; required counts the samples from the keyframe to
    the last that is shown no later than the selected one. Equal targets count
    once; targets without a keyframe or a selected sample are left out, as are
    null ones, and samples of a null pts are selected for none.

    Each sample knows its span (the keyframe before it) and the greatest index
    of its span that is shown no later; the selected sample is an as-of lookup
    within the span. So the rows are those of the targets and of the samples,
    however long spans are. ``bucket`` splits tracks and spans of very many
    samples by pts and index.
    """
    asked = targets.distinct()
    timed = samples.select(*track, "sample_index", "pts", "sync")
    syncs = timed.where("sync").select(*track, F.col("pts").alias("_sync_pts"), F.col("sample_index").alias("_sync_index"))
    placed = as_of(asked, syncs, track, "target", "_sync_pts", "_sync_index", bucket=bucket, prefix="keyframe").drop("keyframe_time").where("keyframe_index is not null")
    own = as_of(timed, syncs, track, "sample_index", "_sync_index", "_sync_index", bucket=bucket, prefix="_of").drop("_of_time").withColumnRenamed("_of_index", "keyframe_index")
    # A sync sample closes the span before it as well as opening its own.
    closing = as_of(timed.where("sync"), syncs, track, "sample_index", "_sync_index", "_sync_index", strict=True, bucket=bucket, prefix="_of").drop("_of_time").withColumnRenamed("_of_index", "keyframe_index")
    within = own.unionByName(closing).where("keyframe_index is not null").select(*track, "keyframe_index", "sample_index", "pts")
    span = [*track, "keyframe_index"]
    needed = prefix_max(within, span, "pts", "sample_index", "_last", bucket=bucket)
    chosen = as_of(placed, within, span, "target", "pts", "sample_index", forward=True, bucket=bucket, prefix="selected").drop("selected_time").where("selected_index is not null")
    last = needed.select(*span, F.col("sample_index").alias("selected_index"), "_last")
    return chosen.join(last, [*span, "selected_index"]).select(*track, "target", "keyframe_index", "selected_index", (F.col("_last") - F.col("keyframe_index") + 1).alias("required"))


def retarget_forward(outputs: DataFrame, requests: DataFrame, stream: list[str]) -> DataFrame:
    """requests (stream, current, target, draining), one a stream, with error, starts_at, clears and reannounces.

    Only a later target of a seek that is active and not drained is taken. If
    no waiting frame of ``outputs`` (stream, kind "Frame" or "Format", pts) is at
    or after it or without a time, all outputs go (clears), and if a format was
    among them it must be announced again. The same target changes nothing; a
    stream without outputs clears nothing that there is.
    """
    error = (
        F.when(F.col("current").isNull(), "invalid: no exact seek is active")
        .when(F.col("target").isNull(), "invalid: no target")
        .when(F.col("target") < F.col("current"), "invalid: target lies before the current one")
        .when(F.col("draining"), "invalid: stream is drained")
    )
    asked = requests.withColumn("error", error)
    later = F.col("error").isNull() & (F.col("target") > F.col("current"))
    waiting = outputs.select(*stream, "kind", "pts").join(asked.where(later).select(*stream, "target"), stream)
    shown = (F.col("kind") == "Frame") & shown_from(F.col("pts"), F.col("target"))
    facts = waiting.groupBy(*stream).agg(F.coalesce(F.bool_or(shown), F.lit(False)).alias("_shown"), F.bool_or(F.col("kind") == "Format").alias("_format"))
    clears = later & ~F.coalesce("_shown", F.lit(False))
    planned = asked.join(facts, stream, "left").withColumns({"starts_at": F.when(F.col("error").isNull(), F.col("target")).otherwise(F.col("current")), "clears": clears})
    return planned.withColumn("reannounces", F.col("clears") & F.coalesce("_format", F.lit(False))).drop("_shown", "_format")


def kept_outputs(outputs: DataFrame, plan: DataFrame, stream: list[str]) -> DataFrame:
    """The outputs that stay under the plan of ``retarget_forward``: those of other streams and of refused requests, and what no later target passes by."""
    of = plan.select(*stream, F.col("clears").alias("_clears"), F.when(F.col("error").isNull() & (F.col("target") > F.col("current")), F.col("target")).alias("_target"))
    passed = (F.col("kind") == "Frame") & ~shown_from(F.col("pts"), F.col("_target"))
    return outputs.join(of, stream, "left").where(~F.coalesce("_clears", F.lit(False)) & ~F.coalesce(passed, F.lit(False))).drop("_clears", "_target")
