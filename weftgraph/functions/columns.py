"""Small column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is cut off the ends of a name: all white space, where SQL's trim takes blanks only.
_EDGES = r"^\s+|\s+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def blank(value: Column) -> Column:
    """Null, empty, or the word null."""
    text = value.cast("string")
    return text.isNull() | text.isin("", "null")


def without_protein(name: Column) -> Column:
    """Every " protein" taken out, wherever it stands."""
    return F.replace(name, F.lit(" protein"), F.lit(""))


def content_key(*columns: Column) -> Column:
    """128 bits in hexadecimal from the columns' content: the same row has the same key on any machine and in any order."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def short_key(text: Column) -> Column:
    """128 bits as 16 bytes, to join and group by where a long text would be shuffled."""
    return F.unhex(F.md5(text.cast("binary")))


def packed(text: Column) -> Column:
    """A text as (head, tail) to shuffle or keep it: 64 hexadecimal digits at its end become 32 bytes, which nothing else
    makes smaller in a shuffle. ``unpacked`` gives the text back."""
    digits = F.when(text.rlike("(?s)[0-9a-f]{64}\\z"), F.right(text, F.lit(64)))
    head = F.when(digits.isNull(), text).otherwise(F.left(text, F.length(text) - 64))
    return F.struct(head.alias("head"), F.unhex(digits).alias("tail"))


def unpacked(value: Column) -> Column:
    tail = F.lower(F.hex(value["tail"]))
    return F.when(tail.isNull(), value["head"]).otherwise(F.concat(value["head"], tail))


def folded(text: Column, by: Column) -> Column:
    """``text`` with every ``by`` in it (null: none) made one mark; ``spread`` gives it back, whatever either holds."""
    plain = F.replace(F.replace(text, F.lit("\x1e"), F.lit("\x1ee")), F.lit("\x1f"), F.lit("\x1em"))
    return F.replace(plain, F.coalesce(by, F.lit("")), F.lit("\x1f"))


def spread(text: Column, by: Column) -> Column:
    plain = F.replace(text, F.lit("\x1f"), F.coalesce(by, F.lit("")))
    return F.replace(F.replace(plain, F.lit("\x1em"), F.lit("\x1f")), F.lit("\x1ee"), F.lit("\x1e"))


def packed_key(text: Column) -> Column:
    """As ``packed``, for keys of 32 hexadecimal digits and nothing else. ``unpacked_key`` gives the text back."""
    own = text.rlike("\\A[0-9a-f]{32}\\z")
    return F.struct(F.when(~own, text).alias("text"), F.when(own, F.unhex(text)).alias("key"))


def unpacked_key(value: Column) -> Column:
    return F.coalesce(F.lower(F.hex(value["key"])), value["text"])


def hash_number(text: Column, digits: int = 7) -> Column:
    """The first hexadecimal digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, digits), 16, 10).cast("long")


def reaction_key(agent: Column, action: Column, target: Column) -> Column:
    """The canonical id of a reaction: equal parts, equal id."""
    return F.concat(F.lit("n_reaction_0_"), F.sha2(F.concat_ws("||", agent, action, target).cast("binary"), 256))


def relationship(action: Column) -> Column:
    """Upper case, blanks made underscores; hyphens stay."""
    return F.replace(F.upper(action), F.lit(" "), F.lit("_"))
