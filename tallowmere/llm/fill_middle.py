"""Fill-in-the-middle samples, cut by word-parallel arithmetic on UTF-8.

A text's units are runs of letters A-Z, a-z and single other code points. The bytes of many texts are viewed as
64-bit words, eight bytes in each. Arithmetic on a word marks, in the high bit of its bytes, letters and
continuation bytes; a byte ends a unit unless the next one continues its code point or both are letters. The
marks of each word are counted (bitwise_count) and summed up, so that the k-th unit's end is found by a
search among the sums and a select within one word. Nothing loops over characters.

The cuts are two numbers a text; the JVM builds and hashes the output from them. `restore` gives the text
back from the output and its form alone, which needs no more since texts that hold a mark stay plain.

Null texts count as empty and stay plain, with no units. A row without an id is cut as if its id were written as
nothing. Repeated rows are cut alike, ties (both cuts at one place) give an empty middle, an empty table gives an
empty table, further columns are ignored. Texts of any length are taken whole; a task holds about
`SLICE_BYTES` of text, or the longest text, with its words at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallowmere.llm.common import text_or_empty

SLICE_BYTES = 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
_EACH, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def letter_marks(w: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is A-Z or a-z. Sums stay within bytes: none exceeds 0x7F + 0x1F."""
    low = (w | (_EACH << np.uint64(5))) & ~_HIGH
    return (low + _EACH * np.uint64(0x80 - ord("a"))) & ~(low + _EACH * np.uint64(0x80 - ord("z") - 1)) & ~w & _HIGH


def continuation_marks(w: np.ndarray) -> np.ndarray:
    """The high bit of each byte 10xxxxxx."""
    return w & ~(w << np.uint64(1)) & _HIGH


def following(marks: np.ndarray) -> np.ndarray:
    """Marks moved to the byte before."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


class Marks:
    """Marked bytes of a run of words, with rank and select."""

    def __init__(self, marks: np.ndarray):
        self.marks = np.append(marks, np.uint64(0))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before byte `at`."""
        below = (np.uint64(1) << (np.uint64(8) * (at & 7).astype(np.uint64))) - np.uint64(1)
        return self.before[at >> 3] + np.bitwise_count(self.marks[at >> 3] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th marked one, k from 1."""
        word = np.searchsorted(self.before, k, "left") - 1
        left = (k - self.before[word]).astype(np.uint64)
        upto = (self.marks[word] >> np.uint64(7)) * _EACH  # in each byte, the marks up to it
        fewer = ((left * _EACH | _HIGH) - _EACH - upto) & _HIGH
        return word * 8 + np.bitwise_count(fewer) + 1


def cuts(data: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units, and code points of prefix and middle, of texts that lie in `data` one after the other up to their `ends`."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    padded = np.zeros(len(data) + 15 & ~7, np.uint8)
    padded[: len(data)] = data
    w = padded.view("<u8")
    letters, inner = letter_marks(w), continuation_marks(w)
    stops = ~(following(inner) | letters & following(letters)) & _HIGH
    last = ends[ends > starts] - 1  # a text's last unit ends with it, whatever the next text begins with
    np.bitwise_or.at(stops, last >> 3, np.uint64(0x80) << (np.uint64(8) * (last & 7).astype(np.uint64)))
    units, points = Marks(stops), Marks(inner)
    first = units.rank(starts)
    n = units.rank(ends) - first
    a, b = h1 % (n + 1), h2 % (n + 1)
    places = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        at = starts.copy()
        some = k > 0
        at[some] = units.select(first[some] + k[some])
        places.append(at)
    chars = lambda x, y: (y - x) - (points.rank(y) - points.rank(x))
    return n, chars(starts, places[0]), chars(places[0], places[1])


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in ("n", "prefix_chars", "middle_chars")]))
def _cut(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    h1, h2, out, k = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False), [], 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(at, at[k] + SLICE_BYTES, "right")) - 1)
        out.append(cuts(data[at[k] : at[stop]], at[k + 1 : stop + 1] - at[k], h1[k:stop], h2[k:stop]))
        k = stop
    columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], ["n", "prefix_chars", "middle_chars"])


def _numbers(id_col: str, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hash of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """`id_col`, n units, form (plain, psm or spm), prefix_chars, middle_chars (null where plain) and output of every row."""
    h = _numbers(f"`{id_col}`", seed)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(f"`{text_col}`").alias("_text"), *[x.alias(f"_h{k}") for k, x in enumerate(h)])
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.col("_text").contains(mark)
    plain = (F.col("_text") == "") | marked | (F.col("_h2") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("_h3") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("_id", "_text", form.alias("form"), _cut("_text", "_h0", "_h1").alias("_c"))
    rows = rows.select("_id", "_text", "form", "_c.*")
    piece = lambda start, length: F.substring("_text", start.cast("int"), length.cast("int"))
    before, inside = F.col("prefix_chars"), F.col("middle_chars")
    prefix, middle, suffix = piece(F.lit(1), before), piece(before + 1, inside), piece(before + inside + 1, F.length("_text"))
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    return rows.select(F.col("_id").alias(id_col), "n", "form", F.when(cut, before).alias("prefix_chars"), F.when(cut, inside).alias("middle_chars"), output.alias("output"))


def restore(form: Column, output: Column) -> Column:
    """The text that an output came from."""
    place = lambda mark: F.call_function("locate", F.lit(mark), output)
    second, third = F.when(form == "psm", place(SUFFIX)).otherwise(place(PREFIX)), place(MIDDLE)
    head, tail, middle = F.substring(output, F.lit(4), second - 4), F.substring(output, second + 3, third - second - 3), F.substring(output, third + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
