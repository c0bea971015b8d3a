"""Row shaping shared by the operators: addresses, brands, flags, geometry text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geometry import as_text

# The notes given instead of a geometry text that is too long.
GEOMETRY_NOTE = "Geometry too large (>{cap:,} chars). Omitted to save tokens."
PLACE_GEOMETRY_NOTE = "Geometry too large (>{cap} chars). Omitted to save tokens."


def first(values: Column) -> Column:
    """First element, or null for a missing or empty list."""
    return F.get(values, F.lit(0))


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def address_line(addresses: Column) -> Column:
    """One line for the first address: its free form, or else its filled parts."""
    address = first(addresses)
    parts = [_filled(address[p]) for p in ("locality", "postcode", "region", "country")]
    return F.coalesce(
        _filled(address["freeform"]), _filled(F.concat_ws(", ", *parts))
    )


def brand(name: Column, wikidata: Column) -> Column:
    """``{name, wikidata}``, null without a name."""
    return F.when(
        F.length(name) > 0,
        F.struct(name.alias("name"), _filled(wikidata).alias("wikidata")),
    )


def has_flag(road_flags: Column, flag: str) -> Column:
    """Whether any flag entry lists ``flag``; missing inner lists are skipped."""
    return F.coalesce(
        F.exists(road_flags, lambda f: F.array_contains(f["values"], flag)), F.lit(False)
    )


def geometry_columns(
    wanted: Column, note: str, cap: int
) -> dict[str, Column]:
    """``geometry`` and ``geometry_note`` from ``geom_type`` and ``parts``, both null
    unless ``wanted``."""
    text = F.when(wanted, as_text("geom_type", "parts"))
    fits = F.length(text) <= cap
    return {
        "geometry": F.when(fits, text),
        "geometry_note": F.when(~fits, F.lit(note.format(cap=cap))),
    }
