"""Fill-in-the-middle: a text is cut at two ranks of its units and put together anew as prefix, suffix, middle.

Where the k-th unit begins is found chunk by chunk. Whether a unit begins at a
byte is a predicate of that byte and the one before it, so chunks overlap by
one byte and can be counted apart, in any order; running sums of the counts
say which chunk owns a rank, and only that chunk is read again for the place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.wordhash import SPACE, text_bytes

#: Bytes of a chunk.
CHUNK_BYTES = 1 << 16

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _characters(bytes_: np.ndarray, before: int) -> np.ndarray:
    """A code point begins at every byte that does not carry one on."""
    return (bytes_ & 0xC0) != 0x80


def _words(bytes_: np.ndarray, before: int) -> np.ndarray:
    """A word begins at a byte that is no white space, behind one that is."""
    space = SPACE[bytes_]
    behind = np.concatenate([[before < 0 or SPACE[before]], space[:-1]])
    return behind & ~space


def _lines(bytes_: np.ndarray, before: int) -> np.ndarray:
    """A line begins at the first byte and behind each line feed."""
    return np.concatenate([[before < 0 or before == 10], bytes_[:-1] == 10])


#: What begins at a byte, given the one before it (-1 at the start of the text).
UNITS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"characters": _characters, "words": _words, "lines": _lines}


def cut_text(data: np.ndarray, draws: tuple[int, int], begins: Callable[[np.ndarray, int], np.ndarray], chunk: int = CHUNK_BYTES) -> tuple[int, int, int]:
    """Number n of units, and the bytes before the two cuts behind so many units as each draw leaves over when divided by n + 1, in order."""
    starts = range(0, len(data), chunk)
    read = lambda at: begins(data[at : at + chunk], int(data[at - 1]) if at else -1)
    sums = np.concatenate([[0], np.cumsum([np.count_nonzero(read(at)) for at in starts])]).astype(np.int64)
    n = int(sums[-1])

    def place(rank: int) -> int:
        if rank == 0 or rank == n:
            return 0 if rank == 0 else len(data)
        owner = int(np.searchsorted(sums, rank, side="right")) - 1
        return owner * chunk + int(np.flatnonzero(read(owner * chunk))[rank - sums[owner]])

    low, high = sorted(draw % (n + 1) for draw in draws)
    return n, place(low), place(high)


def _cut(units: str) -> Callable[..., Column]:
    @F.arrow_udf("n long, low long, high long")
    def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        data, bounds = text_bytes(texts)
        draws = zip(first.to_pylist(), second.to_pylist(), strict=True)
        rows = [cut_text(data[a:b], pair, UNITS[units]) for a, b, pair in zip(bounds[:-1], bounds[1:], draws, strict=True)]
        columns = np.array(rows, np.int64).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(3)], ["n", "low", "high"])

    return cuts


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, units: str = "characters", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n, form, prefix_chars, middle_chars, output, restored), a row for each row.

    n is the number of units: characters, words (runs without white space) or
    lines. Four numbers are drawn from the hash of ``seed`` and doc_id: two
    ranks at which the text is cut, whether it stays plain (``plain_percent``)
    and whether the suffix comes first (``spm``, ``spm_percent`` of all). What
    lies before the first unit belongs to the prefix, unless it ends before
    every unit; what lies between units to the unit before it. A text that is
    empty or holds one of the marks stays plain, with prefix_chars and
    middle_chars (code points) null; else no mark occurs in output but the
    three set here, as each begins with its only ``<``, so the text can be told
    from output and form. A null text is empty, a null doc_id drawn for as
    empty text. Repeated rows give equal rows. Nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    own = docs.select("doc_id", text.alias("text"), *[h.alias(f"h{i + 1}") for i, h in enumerate(drawn)])
    cut = own.select("*", _cut(units)(F.col("text"), F.col("h1"), F.col("h2")).alias("cut"))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    raw, low, high = F.col("text").cast("binary"), F.col("cut.low").cast("int"), F.col("cut.high").cast("int")
    piece = lambda start, length: F.substring(raw, start, length).cast("string")
    parts = cut.select(
        "doc_id", F.col("cut.n").alias("n"), form.alias("form"), "text",
        piece(F.lit(1), low).alias("prefix"), piece(low + 1, high - low).alias("middle"), piece(high + 1, F.octet_length("text") - high).alias("suffix"),
    )
    mark = {name: F.lit(name) for name in (PREFIX, SUFFIX, MIDDLE)}
    psm = F.concat(mark[PREFIX], F.col("prefix"), mark[SUFFIX], F.col("suffix"), mark[MIDDLE], F.col("middle"))
    spm = F.concat(mark[SUFFIX], F.col("suffix"), mark[PREFIX], F.col("prefix"), mark[MIDDLE], F.col("middle"))
    cut_chars = lambda name: F.when(F.col("form") != "plain", F.char_length(name)).cast("long").alias(f"{name}_chars")
    made = parts.select("doc_id", "n", "form", cut_chars("prefix"), cut_chars("middle"), F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"))
    return made.withColumn("restored", restored(F.col("output"), F.col("form")))
