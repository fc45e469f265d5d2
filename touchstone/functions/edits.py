"""Edit lists such as ``S121E/D186H``: parsing, checking, applying and scoring, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchstone.functions.numeric import col
from touchstone.functions.tables import literal_map
from touchstone.functions.text import letters

EDIT_TYPE = "array<struct<wt:string,pos:int,mut:string>>"
# How a file may say "unedited".
UNEDITED = ["wt", "wild-type", "wildtype", "none", "", "nan"]


def parse_edits(field, separators: str = r"[/:,;+\s]+", pattern: str = r"^([A-Za-z])(\d+)([A-Za-z*])$", upper: bool = True) -> Column:
    """Edit list of a variant name; empty for the unedited form, null when a token is malformed.

    ``separators`` and ``pattern`` give the dialect; the pattern's three groups are the stated
    letter, the position and the new letter.
    """
    text = F.trim(F.coalesce(col(field).cast("string"), F.lit("nan")))
    tokens = F.filter(F.split(text, separators), lambda t: t != "")
    case = F.upper if upper else (lambda c: c)
    edits = F.transform(tokens, lambda t: F.struct(
        case(F.regexp_extract(t, pattern, 1)).alias("wt"),
        F.regexp_extract(t, pattern, 2).try_cast("int").alias("pos"),
        case(F.regexp_extract(t, pattern, 3)).alias("mut")))
    good = F.forall(tokens, lambda t: t.rlike(pattern))
    return (
        F.when(F.lower(text).isin(*UNEDITED), F.array().cast(EDIT_TYPE))
        .when(good, edits.cast(EDIT_TYPE))
    )


def edit_count(edits) -> Column:
    """Number of edits; null for an unparseable list."""
    return F.when(col(edits).isNotNull(), F.size(col(edits)))


def agrees(reference, edits, offset=0) -> Column:
    """True when every edit's stated letter stands at its position of the reference."""
    ref, shift = col(reference), offset if isinstance(offset, Column) else F.lit(offset)
    here = lambda e: F.coalesce(
        (e["pos"] + shift >= 1) & (e["pos"] + shift <= F.length(ref)) & (ref.substr((e["pos"] + shift).cast("int"), F.lit(1)) == e["wt"]),
        F.lit(False))
    return F.forall(col(edits), here)


def apply_edits(reference, edits, offset=0) -> Column:
    """The edited string; null when an edit disagrees with the reference."""
    ref, shift = col(reference), offset if isinstance(offset, Column) else F.lit(offset)
    edited = F.aggregate(
        col(edits), ref,
        lambda acc, e: F.when(
            (e["pos"] + shift >= 1) & (e["pos"] + shift <= F.length(acc))
            & (acc.substr((e["pos"] + shift).cast("int"), F.lit(1)) == e["wt"]),
            F.overlay(acc, e["mut"], (e["pos"] + shift).cast("int"), F.lit(1))))
    return edited


def revert_edit(text, edits) -> Column:
    """The reference implied by a variant: each edit's new letter replaced by its stated one."""
    return F.aggregate(col(edits), col(text), lambda acc, e: F.overlay(acc, e["wt"], e["pos"], F.lit(1)))


def pair_sum(edits, table: dict[tuple[str, str], float]) -> Column:
    """Sum of table[wt, mut] over the edits; pairs not in the table add 0."""
    lookup = literal_map({a + b: float(v) for (a, b), v in table.items()}) if table else None
    if lookup is None:
        return F.lit(0.0)
    return F.aggregate(col(edits), F.lit(0.0), lambda acc, e: acc + F.coalesce(F.try_element_at(lookup, F.concat(e["wt"], e["mut"])), F.lit(0.0)))


def property_shift(edits, values: dict[str, float], absolute: bool = False) -> Column:
    """Sum of value(mut) - value(wt) over the edits; letters without a value count 0."""
    lookup = literal_map(values)
    value = lambda c: F.coalesce(F.try_element_at(lookup, c), F.lit(0.0))
    step = lambda e: value(e["mut"]) - value(e["wt"])
    return F.aggregate(col(edits), F.lit(0.0), lambda acc, e: acc + (F.abs(step(e)) if absolute else step(e)))


def difference_edits(reference, text) -> Column:
    """Edit list that turns one equal-length string into another."""
    ref, out = col(reference), col(text)
    pairs = F.transform(F.arrays_zip(letters(ref).alias("wt"), letters(out).alias("mut")), lambda p, i: F.struct(
        p["wt"].alias("wt"), (i + 1).alias("pos"), p["mut"].alias("mut")))
    return F.when(F.length(ref) == F.length(out), F.filter(pairs, lambda p: p["wt"] != p["mut"]).cast(EDIT_TYPE))


def per_edit(score, edits) -> Column:
    """Score divided by max(edit count, 1)."""
    return col(score) / F.greatest(F.size(col(edits)), F.lit(1))
