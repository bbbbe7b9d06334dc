"""The first part of slice headers, up to the order counts, read with the parameter sets that each slice names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.sources.bits import BitBatch, bit_fields

#: Kinds of slices by their code, which counts on for pictures of one kind, and the kinds of the units that hold them.
KINDS = ("P", "B", "I", "SP", "SI")
PLAIN, REFRESH = 1, 5

#: What a slice must know of its sets, as ``bits.sequence_set`` and ``bits.picture_set`` give it: numbers and flags as numbers.
PARAMETERS = ["frame_num_bits", "order_type", "order_lsb_bits", "deltas_zero", "frames_only", "adaptive", "field_order", "coded_width", "coded_height"]

HEAD_DDL = (
    "first_macroblock long, kind string, one_kind boolean, frame_num long, is_field boolean, is_bottom boolean, idr_id long, order_lsb long, delta_bottom long, delta_0 long, delta_1 long, head_bits long, error string"
)


def read_slice_heads(data: pa.Array, unit_type: pa.Array, ref_idc: pa.Array, *parameters: pa.Array) -> pa.Array:
    """Slice units behind their first byte as structs of HEAD_DDL; see ``with_slice_head``."""
    batch = BitBatch(data)
    n = len(batch.at)
    error = np.full(n, None, object)
    numbers = [np.array([0 if v is None else v for v in p.to_pylist()], np.int64) for p in (unit_type, ref_idc, *parameters)]
    unit, idc, frame_num_bits, order_type, lsb_bits, deltas_zero, frames_only, adaptive, field_order, width, height = numbers
    bound = parameters[0].is_valid().to_numpy(zero_copy_only=False)
    one = lambda where=None: batch.read(1, where)[0].astype(bool)

    def refuse(where: np.ndarray, why: str) -> None:
        error[batch.fail(where)] = why

    refresh = unit == REFRESH
    refuse(~np.isin(unit, (PLAIN, REFRESH)), "unsupported: unit type")
    refuse(refresh & (idc == 0), "invalid: refresh is no reference")
    first, _ = batch.unsigned()
    code, _ = batch.unsigned()
    refuse(code > 9, "invalid: slice type")
    kind = np.array(KINDS, object)[code % 5]
    refuse(refresh & ~np.isin(kind, ("I", "SI")), "invalid: refresh is not intra")
    named, _ = batch.unsigned()
    refuse(named > 255, "invalid: id of the picture set")
    refuse(~bound, "invalid: missing parameter set")
    frame_num, _ = batch.read(frame_num_bits)
    refuse(refresh & (frame_num != 0), "invalid: frame number of a refresh")
    is_field = one(frames_only == 0)
    is_bottom = one(is_field)
    # Rows of macroblocks: a field has half of them, and pairs count once where frames and fields alternate.
    rows = height // 16 // np.where(is_field, 2, 1)
    refuse(first * np.where((adaptive == 1) & ~is_field, 2, 1) >= width // 16 * rows, "invalid: first macroblock")
    idr_id, has_idr = batch.unsigned(refresh)
    refuse(has_idr & (idr_id > 65535), "invalid: id of the refresh")
    by_lsb = order_type == 0
    lsb, has_lsb = batch.read(lsb_bits, by_lsb)
    both = (field_order == 1) & ~is_field
    bottom, has_bottom = batch.signed(by_lsb & both)
    told = (order_type == 1) & (deltas_zero == 0)
    delta_0, has_0 = batch.signed(told)
    delta_1, has_1 = batch.signed(told & both)
    error[~batch.ok & np.equal(error, None)] = "invalid: truncated header"
    of = lambda values, where=True: pa.array(values, mask=~(batch.ok & where))
    columns = [
        of(first), of(kind), of(code >= 5), of(frame_num), of(is_field), of(is_bottom), of(idr_id, has_idr), of(lsb, has_lsb), of(bottom, has_bottom), of(delta_0, has_0), of(delta_1, has_1), of(batch.position), pa.array(error, pa.string()),
    ]
    return pa.StructArray.from_arrays(columns, [f.strip().split(" ")[0] for f in HEAD_DDL.split(",")])


def with_slice_head(slices: DataFrame, sets: DataFrame, stream: list[str]) -> DataFrame:
    """``slices`` (stream, data, unit_type, ref_idc) with pps_id and head, a struct of HEAD_DDL.

    ``data`` is the unit behind its first byte and without emulation bytes.
    ``sets`` (stream, pps_id, PARAMETERS) has a row for each picture set with
    what its sequence set says; which holds where a stream sends one anew is
    what ``pictures.bind_parameter_sets`` finds. The id is read first, its set
    looked up, and then the header read by it. A slice whose set is missing or
    that cannot be read has an error and nulls in head.
    """
    named = slices.withColumn("pps_id", bit_fields(F.col("data"), [("first", "unsigned"), ("kind", "unsigned"), ("id", "unsigned")])["id"])
    flags = [F.col(p).cast("long").alias(f"_p_{p}") for p in PARAMETERS]
    bound = named.join(sets.select(*stream, "pps_id", *flags), [*stream, "pps_id"], "left")
    read = F.arrow_udf(read_slice_heads, HEAD_DDL)
    head = read(F.col("data"), F.col("unit_type").cast("long"), F.col("ref_idc").cast("long"), *(F.col(f"_p_{p}") for p in PARAMETERS))
    return bound.withColumn("head", head).drop(*(f"_p_{p}" for p in PARAMETERS))
