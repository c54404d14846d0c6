"""Masking with numbered surfaces, which a table of replacements turns back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import MASKS

# fixed values: how each mask classifies what it covers
CLASSES = ("personal", "personal", "financial")


def numbered(text: Column, surface: str) -> Column:
    """struct<content, replacements array<struct<token, safe_value, classification, original>>> of a text.

    Mail addresses, then phone numbers, then account numbers become [[PII_SURFACE_n]], each kind from left to right, n going on from
    kind to kind. Numbers begin above those that the text already has in such a form, so that restored() gives back the input.
    A null text stays null, without replacements.
    """
    prefix = f"[[PII_{surface.upper()}_"
    own = F.transform(F.regexp_extract_all(text, F.lit(rf"\[\[PII_{surface.upper()}_(\d{{1,15}})\]\]"), F.lit(1)), lambda x: x.cast("long"))
    entry = "array<struct<token: string, safe_value: string, classification: string, original: string>>"
    state = F.struct(text.alias("content"), F.array().cast(entry).alias("replacements"), F.coalesce(F.array_max(own), F.lit(0)).cast("long").alias("n"))
    for (pattern, safe), kind in zip(MASKS, CLASSES):
        state = _covered(state, prefix, pattern, safe, kind)
    return F.struct(state["content"].alias("content"), state["replacements"].alias("replacements"))


def _covered(state: Column, prefix: str, pattern: str, safe: str, kind: str) -> Column:
    """One kind of surface replaced: the pieces between the matches are put together again around the tokens."""

    def step(s: Column) -> Column:
        found = F.regexp_extract_all(s["content"], F.lit(pattern), F.lit(0))
        pieces = F.split(s["content"], pattern, -1)
        token = lambda i: F.concat(F.lit(prefix), (s["n"] + i + 1).cast("string"), F.lit("]]"))
        made = F.array_join(F.transform(pieces, lambda x, i: F.when(i < F.size(found), F.concat(x, token(i))).otherwise(x)), "")
        entries = F.transform(found, lambda x, i: F.struct(token(i).alias("token"), F.lit(safe).alias("safe_value"), F.lit(kind).alias("classification"), x.alias("original")))
        # a null text has no pieces and no matches
        return F.struct(
            F.when(s["content"].isNotNull(), made).alias("content"), F.concat(s["replacements"], F.coalesce(entries, F.slice(s["replacements"], 1, 0))).alias("replacements"),
            (s["n"] + F.coalesce(F.size(found), F.lit(0))).alias("n"),
        )

    return F.transform(F.array(state), step)[0]


def _replaced(content: Column, replacements: Column, by: str) -> Column:
    return F.aggregate(replacements, content, lambda c, r: F.replace(c, r["token"], r[by]))


def restored(masked: Column) -> Column:
    """The text as it was."""
    return _replaced(masked["content"], masked["replacements"], "original")


def safe(masked: Column) -> Column:
    """The text with fixed safe values in place of the numbered tokens."""
    return _replaced(masked["content"], masked["replacements"], "safe_value")
