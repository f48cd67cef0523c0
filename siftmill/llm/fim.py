"""Fill-in-the-middle rearrangement of texts at line ends, by bit-parallelism on big integers.

A text's bytes are classed by bytes.translate, and each class becomes one integer with a bit for each
byte: line feeds, and bytes that begin a code point. Shifting the line feeds by one and joining the
first byte marks where lines begin; the number of set bits counts the lines, and the line of a given
rank is found by halving the integer, each time keeping the half that holds the ranked bit, so the
search costs as much as the integer is long, whatever the number of lines. The same counts, on the
other class, turn bytes into code points. A text needs two bits a byte beside itself and the bytes
that make them.

Rows are independent: no shuffle, no state, any partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import fresh

#: bytes.translate tables: 1 for a line feed; 1 for a byte that begins a code point in UTF-8.
_FEED = bytes(48 + (b == 10) for b in range(256))
_LEAD = bytes(48 + (b & 0xC0 != 0x80) for b in range(256))

_KIND = "struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: string>"
_ARROW = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])


@dataclass(frozen=True)
class Marks:
    """The strings that announce a prefix, a suffix and a middle. None may hold another, or begin with
    an end of itself or of another; then the first that is found in an output is the one that was put there."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = [self.prefix, self.suffix, self.middle]
        for a in every:
            for b in every:
                if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a is not b))):
                    raise ValueError("marks must not overlap")

    def encoded(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def class_mask(data: bytes, table: bytes) -> int:
    """Bit i is set if the table has 1 for byte i."""
    return int(data[::-1].translate(table), 2) if data else 0


def line_starts(data: bytes) -> int:
    """Bit i is set if a line begins at byte i; lines are `[^\\n]*\\n|[^\\n]+`."""
    size = len(data)
    return (class_mask(data, _FEED) << 1 | 1) & ((1 << size) - 1)


def ranked_bit(mask: int, rank: int, size: int) -> int:
    """The place of the set bit with this rank, from 0; size, the mask's length, if there are no more."""
    if rank >= mask.bit_count():
        return size
    low, width = 0, size
    while width > 1:
        half = width // 2
        lower = mask & ((1 << half) - 1)
        held = lower.bit_count()
        if rank < held:
            mask, width = lower, half
        else:
            mask, width, low, rank = mask >> half, width - half, low + half, rank - held
    return low


def chars_before(leads: int, place: int) -> int:
    """Code points that begin before this byte."""
    return (leads & ((1 << place) - 1)).bit_count()


def _arranged(data: bytes, draws: tuple[int, int, int, int], rate: int, spm: int, marks: tuple[bytes, bytes, bytes]) -> tuple:
    pre, suf, mid = marks
    starts = line_starts(data)
    n = starts.bit_count()
    if not data or any(m in data for m in marks) or draws[2] % 100 >= rate:
        return n, "plain", None, None, data
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    at, end = ranked_bit(starts, a, len(data)), ranked_bit(starts, b, len(data))
    leads = class_mask(data, _LEAD)
    before = chars_before(leads, at)
    prefix, middle, suffix = data[:at], data[at:end], data[end:]
    if draws[3] % 100 < spm:
        form, out = "spm", b"".join((suf, suffix, pre, prefix, mid, middle))
    else:
        form, out = "psm", b"".join((pre, prefix, suf, suffix, mid, middle))
    return n, form, before, chars_before(leads, end) - before, out


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row, from the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _bytes(texts: pa.Array) -> list[bytes]:
    """Each text's bytes as they are, none for null."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]




def rearranged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, marks: Marks = Marks()) -> DataFrame:
    """df with n (lines of the text), form (plain, psm or spm), prefix_chars and middle_chars (code points;
    null if plain) and output, which take the place of columns of these names.

    The cuts, whether a text is rearranged (rate in 100) and which form it gets (spm in 100) come
    from the SHA-256 of `seed:id`, so rows don't depend on each other, and rows of one id are cut by
    the same numbers. A null id counts as an empty one, a null text as an empty text; an empty text,
    and one that holds a mark, stays plain. Repeated rows each keep a row; df may be empty. Texts of
    any length are cut whole.
    """
    coded = marks.encoded()

    def run(texts: pa.Array, one: pa.Array, two: pa.Array, three: pa.Array, four: pa.Array) -> pa.Array:
        draws = zip(*(x.to_pylist() for x in (one, two, three, four)))
        rows = [_arranged(t, d, rate, spm, coded) for t, d in zip(_bytes(texts), draws)]
        columns = list(zip(*rows)) or [()] * 5
        parts = [pa.array(c, f.type) for c, f in zip(columns, _ARROW)]
        return pa.StructArray.from_arrays(parts[:4] + [parts[4].view(pa.string())], ["n", "form", "prefix_chars", "middle_chars", "output"])

    done, = fresh(df, "arranged")
    made = F.arrow_udf(run, _KIND)(F.col(text_col).cast("string"), *_draws(id_col, seed))
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    return df.withColumn(done, made).select(*(c for c in df.columns if c not in names), *(F.col(f"{done}.{c}").alias(c) for c in names))


def _restored(data: bytes, form: str | None, marks: tuple[bytes, bytes, bytes]) -> bytes:
    pre, suf, mid = marks
    if form not in ("psm", "spm"):
        return data
    first, second = (pre, suf) if form == "psm" else (suf, pre)
    if not data.startswith(first):
        raise ValueError(f"an output of form {form} must begin with {first.decode()}")
    one, found, rest = data[len(first) :].partition(second)
    two, again, middle = rest.partition(mid)
    if not found or not again:
        raise ValueError(f"an output of form {form} lacks a mark")
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return b"".join((prefix, middle, suffix))


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored", marks: Marks = Marks()) -> DataFrame:
    """df with the column `name`: the text that each output was made of, from the output and its form
    alone. A null output gives an empty text; an output without the marks of its form raises."""
    coded = marks.encoded()

    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([_restored(o, f, coded) for o, f in zip(_bytes(outputs), forms.to_pylist())], pa.binary()).view(pa.string())

    return df.withColumn(name, F.arrow_udf(run, "string")(F.col(output_col).cast("string"), F.col(form_col)))
