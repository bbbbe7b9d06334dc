"""The first part of VP9 frame headers, up to the frame context, over whole batches.

It says what a frame refreshes, refers to and takes its size from, which is
what slots, references and inherited sizes are worked out of.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.sources.bits import BitBatch

#: The first bits of a frame, the code before sizes, and the colour space without a range of its own.
MARKER, SYNC, SRGB = 2, 0x498342, 7

HEAD_DDL = (
    "profile long, show_existing long, key boolean, shown boolean, resilient boolean, intra_only boolean, reset_context long, bit_depth long, color_space long, full_range boolean, halved_across boolean, halved_down boolean, refresh long, "
    "references array<long>, biases array<boolean>, size_slot long, width long, height long, render_width long, render_height long, precise boolean, filter long, refresh_context boolean, parallel boolean, context long, head_bits long, error string"
)


def read_frame_heads(column: pa.Array) -> pa.Array:
    """Frame packets as structs of HEAD_DDL; see ``frame_head``."""
    batch = BitBatch(column)
    n = len(batch.at)
    error = np.full(n, None, object)
    every = np.ones(n, bool)

    def refuse(where: np.ndarray, why: str) -> None:
        error[batch.fail(where)] = why

    def flag(where: np.ndarray) -> np.ndarray:
        return batch.read(1, where)[0].astype(bool)

    marker, read = batch.read(2)
    refuse(read & (marker != MARKER), "invalid: frame marker")
    low, high = flag(every), flag(every)
    profile = low + 2 * high
    refuse(flag(profile == 3), "invalid: reserved bit of the profile")
    existing = flag(every)
    slot, _ = batch.read(3, existing)
    coded = ~existing
    key = coded & ~flag(coded)
    shown, resilient = flag(coded) | existing, flag(coded)
    inter = coded & ~key
    intra = key | flag(inter & ~shown)
    reset, _ = batch.read(2, inter & ~resilient)
    code, read = batch.read(24, intra)
    refuse(read & (code != SYNC), "invalid: sync code")
    # Frames of profile 0 that are no key frames have its only format.
    told = key | intra & (profile > 0)
    twelve = flag(told & (profile >= 2))
    space, _ = batch.read(3, told)
    rgb = told & (space == SRGB)
    refuse(rgb & (profile % 2 == 0), "invalid: colour space of the profile")
    refuse(flag(rgb), "invalid: reserved bit of the colours")
    full = flag(told & ~rgb) | rgb
    chosen = told & ~rgb & (profile % 2 == 1)
    across, down = flag(chosen), flag(chosen)
    refuse(flag(chosen), "invalid: reserved bit of the colours")
    refresh, _ = batch.read(8, inter)
    refresh = np.where(key, 255, refresh)
    predicted = inter & ~intra
    references, biases = [], []
    for _ in range(3):
        references.append(batch.read(3, predicted)[0])
        biases.append(flag(predicted))
    size_slot, open_ = np.full(n, -1), predicted
    for reference in references:
        takes = flag(open_)
        size_slot = np.where(takes, reference, size_slot)
        open_ = open_ & ~takes
    own = intra | open_
    width, height = batch.read(16, own)[0] + 1, batch.read(16, own)[0] + 1
    other = flag(coded)
    render_width, render_height = batch.read(16, other)[0] + 1, batch.read(16, other)[0] + 1
    precise = flag(predicted)
    switchable = flag(predicted)
    kind, _ = batch.read(2, predicted & ~switchable)
    refresh_context, parallel = flag(coded & ~resilient), flag(coded & ~resilient)
    context, _ = batch.read(2, coded)
    error[~batch.ok & np.equal(error, None)] = "invalid: truncated header"
    fine = batch.ok
    of = lambda values, where=every: pa.array(values, mask=~(fine & where))
    rows = lambda columns, kind: pa.array([[c[k].item() for c in columns] if fine[k] and predicted[k] else None for k in range(n)], pa.list_(kind))
    plain = intra & ~told
    colours = told | plain
    # 4:2:0 where the profile leaves no choice, 4:4:4 for sRGB.
    even = plain | told & ~rgb & (profile % 2 == 0)
    inherits = coded & ~own
    columns = [
        of(profile), of(slot, existing), of(key), of(shown), of(resilient), of(intra), of(reset), of(np.where(told & (profile >= 2), np.where(twelve, 12, 10), 8), colours), of(np.where(plain, 1, space), colours), of(full, colours), of(across | even, colours), of(down | even, colours),
        of(refresh), rows(references, pa.int64()), rows(biases, pa.bool_()), of(np.where(existing, slot, size_slot), existing | inherits), of(width, own), of(height, own), of(np.where(other, render_width, width), other | own), of(np.where(other, render_height, height), other | own),
        of(precise), of(np.where(switchable, 4, kind), predicted), of(refresh_context), of(parallel | coded & resilient), of(np.where(intra | resilient, 0, context)), of(batch.position), pa.array(error, pa.string()),
    ]
    names = [f.strip().split(" ")[0] for f in HEAD_DDL.split(",")]
    return pa.StructArray.from_arrays(columns, names)


def frame_head(packet: Column) -> Column:
    """struct of a frame packet's first fields, or an error and nulls.

    ``show_existing`` is the slot of a frame that is shown again; it and frames
    that take their size from a reference name the slot in ``size_slot`` and
    have no width of their own. ``filter`` is 0 smooth, 1 regular, 2 sharp, 3
    bilinear and 4 chosen by block. Colours are those that the frame tells:
    predicted frames keep those of their first reference and have nulls.
    ``head_bits`` is where the loop filter follows.
    """
    return F.arrow_udf(read_frame_heads, HEAD_DDL)(packet)
