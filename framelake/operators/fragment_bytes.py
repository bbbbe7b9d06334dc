"""Movie fragments from their bytes: headers and runs whose flag bits say which fields are there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.scalars import big_endian
from framelake.operators.fragments import data_base, placed_samples, track_defaults
from framelake.operators.runs import merged
from framelake.sources.mp4 import holders
from framelake.storage import written

#: Flag bits of a fragment's header with the fields that they announce and their bytes, in order.
HEADER_FIELDS = [(0x1, "base", 8), (0x2, "description", 4), (0x8, "duration", 4), (0x10, "size", 4), (0x20, "flags", 4)]
IS_EMPTY, BASE_IS_MOOF = 0x10000, 0x20000

#: Flag bits of a run for the fields before its entries, and of those in each.
DATA_OFFSET, FIRST_FLAGS = 0x1, 0x4
ENTRY_FIELDS = [(0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")]

#: Boxes with what is read of fragments.
KINDS = ["tfhd", "tfdt", "trun", "trex"]

#: Entries of a run that are cut from it at once.
PIECE_ENTRIES = 64


def _number(data: Column, at: Column, size: int) -> Column:
    """An unsigned number at an offset that is a column; null past the end, and for eight bytes over the greatest bigint."""
    part = F.hex(F.substring(data, at + 1, F.lit(size)))
    there = F.length(data) >= at + size
    return F.when(there & (part < "8") if size == 8 else there, F.conv(part, 16, 10).cast("long"))


def _signed(number: Column) -> Column:
    return F.when(number >= 1 << 31, number - (1 << 32)).otherwise(number)


def _has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def with_fragment_header(rows: DataFrame, payload: str) -> DataFrame:
    """``rows`` with track_id, h_base, h_description, h_duration, h_size, h_flags, is_empty, base_is_moof and header_error of a fragment header; fields that are not there are null."""
    p = F.col(payload)
    # In steps: methods of generated code over 8,000 bytes are never compiled.
    steps = rows.withColumns({"_word": big_endian(p, 0, 4), "track_id": big_endian(p, 4, 4)}).withColumn("_flags", F.col("_word").bitwiseAND(0xFFFFFF))
    at: Column = F.lit(8)
    places = {}
    for bit, name, size in HEADER_FIELDS:
        places[f"_at_{name}"] = at
        at = at + F.when(_has(F.col("_flags"), bit), size).otherwise(0)
    steps = steps.withColumns({**places, "_end": at})
    fields = {f"h_{name}": F.when(_has(F.col("_flags"), bit), _number(p, F.col(f"_at_{name}"), size)) for bit, name, size in HEADER_FIELDS}
    known = reduce(lambda a, b: a | b, [bit for bit, _, _ in HEADER_FIELDS]) | IS_EMPTY | BASE_IS_MOOF
    found = steps.withColumns({**fields, "is_empty": _has(F.col("_flags"), IS_EMPTY), "base_is_moof": _has(F.col("_flags"), BASE_IS_MOOF)})
    error = (
        F.when(F.col("_flags").isNull(), "invalid: truncated header")
        .when(F.col("_word").bitwiseAND(0xFFFFFFFF ^ known) != 0, "unsupported: version or flags")
        .when(F.col("base_is_moof") & _has(F.col("_flags"), 1), "invalid: two data bases")
        .when(F.col("track_id") == 0, "invalid: track id is zero")
        .when(F.col("track_id").isNull() | (F.length(p) != F.col("_end")), "invalid: length differs from flags")
        .when(F.col("h_description") == 0, "invalid: no description")
    )
    return found.withColumn("header_error", error).drop("_word", "_flags", "_end", *places)


def decode_time(payload: Column) -> Column:
    """struct(value, error) of a fragment's decode time, of four bytes or, in version 1, of eight."""
    version = big_endian(payload, 0, 1)
    value = F.when(version == 0, _number(payload, F.lit(4), 4)).otherwise(_number(payload, F.lit(4), 8))
    error = F.when(F.coalesce((version > 1) | (big_endian(payload, 1, 3) != 0), F.lit(True)), "unsupported: version or flags").when(F.length(payload) != F.when(version == 0, 8).otherwise(12), "invalid: length").when(value.isNull(), "invalid: time over 63 bits")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def extends_rows(payloads: DataFrame) -> DataFrame:
    """(path, track_id, description, duration, size, flags, error) of the defaults of tracks; one that cannot be read has the error and nulls."""
    p = F.col("payload")
    error = F.when(F.coalesce(big_endian(p, 0, 4) != 0, F.lit(True)), "unsupported: version or flags").when(F.length(p) != 24, "invalid: length")
    names = ["track_id", "description", "duration", "size", "flags"]
    return payloads.withColumn("error", error).select("path", *(F.when(F.col("error").isNull(), big_endian(p, 4 + 4 * k, 4)).alias(n) for k, n in enumerate(names)), "error")


def with_run_head(rows: DataFrame, payload: str) -> DataFrame:
    """``rows`` with run_error, data_offset, and what ``run_entries`` needs of a run: n, version, bits, first (the place of the first entry), width and first_flags."""
    p = F.col(payload)
    known = reduce(lambda a, b: a | b, [bit for bit, _ in ENTRY_FIELDS]) | DATA_OFFSET | FIRST_FLAGS
    head = rows.withColumns({"_word": big_endian(p, 0, 4), "n": big_endian(p, 4, 4)}).withColumns({"version": F.shiftright("_word", 24), "bits": F.col("_word").bitwiseAND(0xFFFFFF)}).drop("_word")
    four = lambda bit: F.when(_has(F.col("bits"), bit), 4).otherwise(0)
    width = reduce(lambda a, b: a + b, [four(bit) for bit, _ in ENTRY_FIELDS])
    sized = head.withColumns({"first": 8 + four(DATA_OFFSET) + four(FIRST_FLAGS), "width": width})
    error = (
        F.when(F.col("n").isNull(), "invalid: truncated run")
        .when((F.col("version") > 1) | (F.col("bits").bitwiseAND(0xFFFFFF ^ known) != 0), "unsupported: version or flags")
        .when(_has(F.col("bits"), FIRST_FLAGS) & _has(F.col("bits"), 0x400), "invalid: flags of the first and of each sample")
        .when(F.length(p) != F.col("first") + F.col("n") * F.col("width"), "invalid: length differs from count")
    )
    offset = F.when(_has(F.col("bits"), DATA_OFFSET), _signed(_number(p, F.lit(8), 4)))
    first_flags = F.when(_has(F.col("bits"), FIRST_FLAGS), _number(p, 8 + four(DATA_OFFSET), 4))
    return sized.withColumns({"run_error": error, "data_offset": offset, "first_flags": first_flags})


def run_entries(rows: DataFrame, payload: str, sound: Column) -> DataFrame:
    """``rows`` of ``with_run_head`` with one row an entry of the runs that are ``sound``: k from 0, duration, size, flags (of the first sample where only that has its own) and shift; others keep one row with nulls.

    What no flag announces is null. Which place a field has in an entry follows
    from the flags before it.
    """
    # Cut into pieces of some entries before there are rows of them, so that no row copies a long run.
    piece = F.explode_outer(F.when(sound & (F.col("n") > 0), F.expr(f"sequence(0L, n - 1, {PIECE_ENTRIES}L)")))
    pieces = rows.withColumn("_k", piece).withColumns({"_part": F.substring(F.col(payload), (F.col("first") + F.col("_k") * F.col("width") + 1).cast("int"), PIECE_ENTRIES * F.col("width")), "_last": F.least(F.col("n") - F.col("_k"), F.lit(PIECE_ENTRIES)) - 1}).drop(payload, "n", "first")
    each = pieces.withColumn("_i", F.explode_outer(F.when(F.col("_k").isNotNull(), F.expr("sequence(0L, _last)"))))
    entry = F.substring(F.col("_part"), (F.col("_i") * F.col("width") + 1).cast("int"), F.col("width"))
    at: Column = F.lit(1)
    places = {}
    for bit, name in ENTRY_FIELDS:
        places[f"_at_{name}"] = at
        at = at + F.when(_has(F.col("bits"), bit), 8).otherwise(0)
    placed = each.withColumns({"k": F.col("_k") + F.col("_i"), "_hex": F.hex(entry), **places}).drop("_part", "_k", "_i", "_last", "width")
    number = lambda name: F.conv(F.substring(F.col("_hex"), F.col(f"_at_{name}"), F.lit(8)), 16, 10).cast("long")
    read = placed.withColumns({name: F.when(_has(F.col("bits"), bit), number(name)) for bit, name in ENTRY_FIELDS})
    flags, shift = F.coalesce("flags", F.when(F.col("k") == 0, F.col("first_flags"))), F.when(F.col("version") == 0, F.col("shift")).otherwise(_signed(F.col("shift")))
    return read.withColumns({"flags": flags, "shift": shift}).drop("_hex", *places, "version", "bits", "first_flags")


def samples_of_fragments(files: DataFrame) -> DataFrame:
    """(path, track_id, fragment, run, k, offset, size, dts, pts, duration, description, sync, error) of the samples of all fragments of files.

    ``fragment`` is the place of the fragment's box, ``run`` counts its runs. A
    field is that of the sample, else for the first sample the run's, else the
    fragment's, else the track's; without any it is an error. Decode times go on
    from the fragment before of the track where the fragment has none of its own.
    A fragment whose boxes cannot be read has one row with the error. Times and
    places behind an error in a fragment are null, as they are not known.
    """
    held = holders(files, "traf", KINDS)
    held = written(held) if "content" in files.columns else held
    trafs = held.where("parent IS NOT NULL").select("path", F.col("box").alias("fragment"), F.col("parent").alias("moof"), *(f(k).alias(f"{name}{k}") for k in ("tfhd", "tfdt") for f, name in ((F.size, "_n_"), (F.array_max, "_"))), "trun")
    # Dealt by file once, while rows are runs: all windows and the join from here on are within files. What is
    # read of payloads is spread over the stages between, each of which generates one method of limited length.
    dealt = with_fragment_header(trafs, "_tfhd").drop("_tfhd").select("*", F.posexplode_outer("trun").alias("run", "payload")).drop("trun").repartition("path")
    headed = with_run_head(dealt, "payload")
    # A sound run without entries is as if it were not there.
    there = F.col("run").isNotNull() & (F.col("run_error").isNotNull() | (F.col("n") > 0))
    of_run = F.when(there, F.coalesce("run_error", F.when(F.col("is_empty"), "invalid: empty fragment has a run")))
    fragment = Window.partitionBy("path", "fragment")
    judged = headed.withColumns({"_there": there, "_of_run": of_run}).withColumns({"_of_runs": F.min("_of_run").over(fragment), "_runs": F.count_if("_there").over(fragment)}).drop("_of_run", "run_error")
    timed = judged.withColumns({"_time": F.when(F.col("_tfdt").isNotNull(), decode_time(F.col("_tfdt"))), "_base": data_base(F.col("h_base"), F.col("base_is_moof"), F.col("moof"))}).drop("_tfdt")
    extends = extends_rows(held.where(F.size("trex") > 0).select("path", F.explode("trex").alias("payload")).repartition("path"))
    defaults = track_defaults(extends.where("error IS NULL").drop("error"), ["path", "track_id"])
    known = defaults.select(F.col("path").alias("_path"), F.col("track_id").alias("_id"), F.struct("description", "duration", "size", "flags", "error").alias("_track"))
    # The join is by file, as the rows are dealt; an equality of tracks would have them dealt anew. A file has few tracks.
    of_track = timed.join(merged(known), (F.col("path") == F.col("_path")) & F.col("track_id").between(F.col("_id"), F.col("_id")), "left").drop("_path", "_id")
    fault = (
        F.when(F.col("_n_tfhd") == 0, "invalid: fragment has no header").when(F.col("_n_tfhd") > 1, "invalid: more than one header").when(F.col("_n_tfdt") > 1, "invalid: more than one decode time")
        .when(F.col("header_error").isNotNull(), F.col("header_error")).when(F.col("_time.error").isNotNull(), F.col("_time.error")).when(F.col("_base.error").isNotNull(), F.col("_base.error"))
        .when(F.col("_track.error").isNotNull(), F.col("_track.error")).when(F.coalesce("h_description", "_track.description").isNull(), "invalid: no description")
        .when((F.col("_runs") == 0) & ~F.col("is_empty"), "invalid: fragment has no run").otherwise(F.col("_of_runs"))
    )
    default = {f"_{c}": F.coalesce(f"h_{c}", f"_track.{c}") for c in ("duration", "size", "flags")}
    head = ["version", "bits", "n", "first", "width", "first_flags", "data_offset"]
    runs = of_track.select("path", "fragment", "track_id", F.col("_time.value").alias("start"), F.col("_base.base").alias("base"), F.coalesce("h_description", "_track.description").alias("description"), *(v.alias(k) for k, v in default.items()), fault.alias("fault"), "_there", F.col("run").cast("long").alias("run"), "payload", *head)
    # Of a fragment that cannot be read one row stays, which has no part in places and times.
    good = runs.where(F.when(F.col("fault").isNull(), F.col("_there")).otherwise(F.coalesce("run", F.lit(0)) == 0)).drop("_there").withColumn("run", F.when(F.col("fault").isNull(), F.col("run")))
    samples = run_entries(good, "payload", F.col("fault").isNull())
    filled = samples.withColumns({c: F.when(F.col("k").isNotNull(), F.coalesce(c, f"_{c}")) for c in ("duration", "size", "flags")}).drop(*default)
    placed = placed_samples(filled.withColumn("opens", F.col("k") == 0), ["path", "track_id", "fragment"])
    # A fragment's own time holds for its first sample; the sums start anew there.
    first = (F.col("run") == 0) & (F.col("k") == 0)
    up_to = Window.partitionBy("path", "track_id").orderBy("fragment", "run", "k").rowsBetween(Window.unboundedPreceding, 0)
    wrong = F.count("error").over(up_to)
    summed = placed.withColumns({"_own": F.when(first, F.col("start")), "_spent": F.coalesce(F.sum("duration").over(up_to), F.lit(0)) - F.coalesce("duration", F.lit(0)), "_wrong": wrong})
    opened = summed.withColumn("_from", F.when(F.col("_own").isNotNull(), F.struct((F.col("_own") - F.col("_spent")).alias("at"), (F.col("_wrong") - F.when(F.col("error").isNotNull(), 1).otherwise(0)).alias("wrong"))))
    island = opened.withColumn("_start", F.last("_from", ignorenulls=True).over(up_to))
    lost = F.col("_wrong") > F.coalesce("_start.wrong", F.lit(0))
    read = F.col("k").isNotNull()
    times = island.withColumn("dts", F.when(read & ~lost, F.coalesce("_start.at", F.lit(0)) + F.col("_spent")).cast("long")).withColumn("pts", F.col("dts") + F.coalesce("shift", F.lit(0)))
    when_read = [F.when(read, F.col(c)).alias(c) for c in ("offset", "size", "dts", "pts", "duration", "description", "sync")]
    return times.select("path", "track_id", "fragment", "run", "k", *when_read, F.coalesce("fault", "error").alias("error"))
