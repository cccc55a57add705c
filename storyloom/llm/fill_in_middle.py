"""Fill-in-the-middle: a text is cut in prefix, middle and suffix at the ends of its units, and the pieces change places.

Each text is decoded to an array of UTF-32 code points.  A code point has a class; a unit ends wherever the classes of two
neighbours are in the unit's table of breaking pairs (lines: after a newline; words: a space before a non-space), and at the end.
A text of n units has n + 1 places to cut.  Four numbers, the first four groups of eight hex digits of the SHA-256 of ``seed:id``,
choose them: the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger.  The form is
plain if the text is empty, holds one of the sentinels, or h3 % 100 >= rate; else ``spm`` if h4 % 100 < spm, else ``psm``.

Rows: null is the empty text; a null id is the id without digits; rows that repeat an id are cut by the same numbers, each in its
own text.  Texts of any length stay whole; nothing is shuffled, one row comes out for each that goes in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .shared_store import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: By unit: the code points of class 1 (others have class 0), and whether a unit ends between two classes [left, right].
UNITS: dict[str, tuple[str, np.ndarray]] = {
    "lines": ("\n", np.array([[False, False], [True, True]])),
    "words": (" \t\n\v\f\r", np.array([[False, False], [True, False]])),
}
_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def unit_ends(points: np.ndarray, unit: str) -> np.ndarray:
    """0 and the end of each unit, in code points."""
    if not len(points):
        return np.zeros(1, dtype=np.int64)
    members, breaks = UNITS[unit]
    classes = np.isin(points, code_points(members)).astype(np.int8)
    inner = np.flatnonzero(breaks[classes[:-1], classes[1:]]) + 1
    return np.concatenate(([0], inner, [len(points)]))


def _piece(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def rearrange(text: str, h: tuple[int, int, int, int], unit: str, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    points = code_points(text)
    ends = unit_ends(points, unit)
    n = len(ends) - 1
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = int(ends[first]), int(ends[second])
    prefix, middle, suffix = _piece(points[:a]), _piece(points[a:b]), _piece(points[b:])
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int, unit: str = "lines", rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, then n, form, prefix_chars, middle_chars (null if plain) and output."""
    bounded_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]

    @F.pandas_udf(_RESULT)
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, *hs in batches:
            rows = [rearrange(t, h, unit, rate, spm) for t, *h in zip(text, *hs)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    done = docs.select(*[F.col(c) for c in keep], cut(F.coalesce(F.col(text_col), F.lit("")), *numbers).alias("__cut"))
    return done.select(*keep, "__cut.*")


def restore(output: Column, form: Column) -> Column:
    """The text before it was rearranged.  A text of form psm or spm holds no sentinel, and no end of a piece makes one with the sentinel after it."""
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    at, mid = F.call_function("locate", second, output), F.locate(MIDDLE, output)
    size = len(PREFIX)
    one = F.substr(output, F.lit(size + 1), at - size - 1)
    two = F.substr(output, at + size, mid - at - size)
    three = F.substr(output, mid + size)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
