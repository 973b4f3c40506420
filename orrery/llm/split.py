"""Splitting oversized items at natural boundaries, with SQL functions only.

A text is first rewritten so that its length is its size: every CJK code point is followed by three pad characters and
every other code point outside the basic plane by one, so ``length / 4`` is at least the size in tokens
(``ceil(o / 4) + ceil(0.95 * c)``). One regular expression then consumes the rewritten text piece by piece: bounded
quantifiers, alternatives ordered from the strongest boundary to the weakest, single characters as the last. The
overlap is looked back for from each piece's start, in as many pieces before it as can hold it. Removing the pads gives
the pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import CJK_SIZES, approx_tokens
from orrery.operators.skew import partitions

# Noncharacters, so that no text has them: the pad, and what stands for a text's own ones.
PAD, ESC = "\ufdd2", "\ufdd1"


def _pad(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, ESC, ESC + "\ufdd3"), PAD, ESC + "\ufdd4")
    out = F.regexp_replace(out, rf"[{CJK_SIZES}]", "$0" + PAD * 3)
    out = F.regexp_replace(out, r"[\x{10000}-\x{1ffff}\x{2fffe}-\x{10ffff}]", "$0" + PAD)
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(out)


def _unpad(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit(PAD), F.lit("")), F.lit(ESC + "\ufdd4"), F.lit(PAD)), F.lit(ESC + "\ufdd3"), F.lit(ESC))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(out)


#: A cut may not part a code point from its pads or its escape, nor \r from \n. After a blank only the latter may happen.
_WHOLE = r"(?![\x{fdd2}-\x{fdd4}]|(?<=\r)\n)"
_LINE_END = r"(?!(?<=\r)\n)"
#: Places to cut at from the strongest boundary to the weakest, and the share of the room a piece must fill to end there.
BOUNDARIES = [
    (r"(?<=\n)(?=\#{1,6} )", 0.5),                                            # before a heading
    (r"(?<=\n)(?<=\n[ \t\r]{0,8}\n)", 0.5),                                   # after a blank line
    (r"(?<=\n)", 0.5),                                                        # after a line
    (r"(?:(?<=\s)(?<=[.!?;:][\"')\]]?\s)" + _LINE_END + r"|(?<=[\u3002\uff01\uff1f]\x{fdd2}{3}))", 0.3),  # after a sentence
    (r"(?<=\s)" + _LINE_END, 0.1),                                            # after a word
]
#: What a text must have somewhere for the first two boundaries to be looked for.
RARE = [r"\n\#{1,6} ", r"\n[ \t\r]{0,8}\n"]


def cutter(room: int, rare: Sequence[bool] = (True, True)) -> str:
    """The expression that consumes at most ``room`` padded characters at a time; ``rare`` tells which of the first
    boundaries the text has."""
    parts = [rf".{{1,{room}}}+\z"]
    parts += [rf".{{{max(1, int(room * share))},{room}}}{look}" for i, (look, share) in enumerate(BOUNDARIES) if i >= len(rare) or rare[i]]
    return "(?s)" + "|".join([*parts, rf".{{1,{room}}}{_WHOLE}", rf".{{1,{room}}}"])


def _cores(text: Column, room: int) -> Column:
    """The consecutive pieces of a padded text, without overlap."""
    cut = lambda *rare: F.regexp_extract_all(text, F.lit(cutter(room, rare)), F.lit(0))
    heading, blank = (text.rlike(r) for r in RARE)
    return F.when(heading & blank, cut(True, True)).when(heading, cut(True, False)).when(blank, cut(False, True)).otherwise(cut(False, False))


def _settled(df: DataFrame, keys: list[str], column: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: it comes from a generator, so that the optimizer can't copy its
    expression into each of the places, and into functions called per element, that use it."""
    return df.select(*keys, F.explode(F.array(F.struct(column))).alias("_x")).select(*keys, "_x.*")


def pieces(items: DataFrame, key: str, body: str, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """(key, piece_no INT from 1, n_pieces INT, overlap STRING, text STRING, tokens INT) of each item with a body.

    ``text`` starts with ``overlap``, as much of the text before it as ``overlap_tokens`` hold; the texts without their
    overlaps are, in order, the body. No text is larger than ``max_tokens``. An item that fits is one piece. A repeated key counts once, with
    its smallest body; null keys and bodies give no rows, an empty body gives one empty piece. Other columns are
    ignored. ``0 <= overlap_tokens < max_tokens`` is required.
    """
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("the overlap must be smaller than the limit")
    some = items.filter(F.col(key).isNotNull() & F.col(body).isNotNull()).select(key, F.col(body).alias("_b"))
    once = some.repartition(partitions(items.sparkSession), key).groupBy(key).agg(F.min("_b").alias("_b"))
    room, back = 4 * (max_tokens - overlap_tokens), 4 * overlap_tokens
    sized = _settled(once, [key, "_b"], (approx_tokens(F.col("_b")) <= max_tokens).alias("_fits"))
    sized = _settled(sized, [key, "_fits"], F.when(~F.col("_fits"), _pad(F.col("_b"))).otherwise(F.col("_b")).alias("_p"))
    rows = _settled(sized, [key, "_fits"], F.when(F.col("_fits"), F.array("_p")).otherwise(_cores(F.col("_p"), room)).alias("_cores"))
    # a piece that isn't the last fills at least the least share of the room, so this many hold the overlap
    reach = -(-back // max(1, int(room * min(share for _, share in BOUNDARIES))))
    before = lambda i: F.right(F.array_join(F.slice("_cores", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), ""), F.lit(back))
    with_before = F.transform("_cores", lambda c, i: F.struct(c.alias("core"), (F.when(i > 0, before(i)).otherwise("") if back else F.lit("")).alias("before")))
    rows = rows.select(key, "_fits", with_before.alias("_parts"), F.size("_cores").alias("n_pieces"))
    rows = rows.select(key, "_fits", "n_pieces", F.posexplode("_parts").alias("_i", "_part"))
    # the text before may begin within a code point
    rows = rows.select(key, "_fits", "n_pieces", "_i", F.col("_part.core").alias("_core"), F.regexp_replace("_part.before", r"^[\x{fdd2}-\x{fdd4}]+", "").alias("_before"))
    plain = lambda c: F.when(F.col("_fits"), c).otherwise(_unpad(c))
    out = rows.select(key, (F.col("_i") + 1).cast("int").alias("piece_no"), F.col("n_pieces").cast("int"), plain(F.col("_before")).alias("overlap"), plain(F.concat("_before", "_core")).alias("text"))
    return out.withColumn("tokens", approx_tokens(F.col("text")).cast("int"))
