"""How large a text is in tokens: the heuristic, or an exact counter put in its place.

Sizes are pairs (other, cjk) that add up and become tokens after adding (``units_to_tokens``). An exact counter gives
four units a token, so the sum of its blocks comes out as the sum of their tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import text as T

_CJK = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), T.CJK_SIZES) + "]")


class Counter:
    """The heuristic: a quarter of a token a UTF-16 unit, 0.95 a CJK code point."""

    def columns(self, text: Column) -> tuple[Column, Column]:
        return T.other_units(text), T.cjk_chars(text)

    def sizes(self, text: str) -> tuple[int, int]:
        units = lambda s: sum(2 if ord(c) > 0xFFFF else 1 for c in s)
        cjk = _CJK.findall(text)
        return units(text) - units(cjk), len(cjk)

    def tokens(self, text: str) -> int:
        other, cjk = self.sizes(text)
        return math.ceil(other / 4) + math.ceil(cjk * T.CJK_TOKENS)


class Exact(Counter):
    """``encoder()`` gives a function from a text to its number of tokens; it is made once a task, texts come in batches.

    Where it can't be made on the driver, as without its vocabulary, the heuristic stays in place.
    """

    def __new__(cls, encoder: Callable[[], Callable[[str], int]]) -> Counter:
        try:
            encoder()("")
        except Exception:
            return Counter()
        return super().__new__(cls)

    def __init__(self, encoder: Callable[[], Callable[[str], int]]) -> None:
        self.encoder, self.count = encoder, encoder()

    def columns(self, text: Column) -> tuple[Column, Column]:
        encoder = self.encoder

        def units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            count = encoder()
            for batch in batches:
                yield batch.map(lambda t: 4 * count(t) if t else 0)

        units.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(units, "bigint")(text), F.lit(0)

    def sizes(self, text: str) -> tuple[int, int]:
        return 4 * self.count(text), 0
