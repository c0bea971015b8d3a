"""Places: search, nearest, count, and the category catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions import shaping
from waymark.functions.geodesy import whole_metres
from waymark.operators.screening import accepted_points, stripped
from waymark.plans.radius import DEFAULT_OPTIONS, Criteria, RadiusOptions
from waymark.plans.results import answer_points, with_data_version
from waymark.plans.skew import balanced_attach, balanced_join
from waymark.plans.tiles import radius_counts, radius_nearest
from waymark.sources.manifest import Layer, around


def _criteria() -> Criteria:
    closed = F.coalesce(F.col("operating_status"), F.lit("open")) == "permanently_closed"
    return Criteria(
        match={"category": F.col("categories.primary")},
        traits={"closed": closed},
        residual=F.col("include_closed") | ~F.col("closed"),
    )


def _place_columns(with_geometry: bool) -> dict[str, Column]:
    columns = {
        "name": F.col("names.primary"),
        "place_lat": F.col("rep_y"),
        "place_lng": F.col("rep_x"),
        "confidence": F.col("confidence"),
        "address": shaping.address_line(F.col("addresses")),
        "phone": shaping.first(F.col("phones")),
        "website": shaping.first(F.col("websites")),
        "brand": shaping.brand(F.col("brand.names.primary"), F.col("brand.wikidata")),
    }
    if with_geometry:
        columns |= {"geom_type": F.col("geom_type"), "parts": F.col("parts")}
    return columns


def _search(
    points: DataFrame,
    places: Layer,
    limit: Column,
    most: int,
    with_geometry: bool,
    suggestion: Column,
    options: RadiusOptions,
) -> DataFrame:
    site = [c for c in points.columns if c != "query_id"]
    sites = points.select(*site).distinct()
    near = around(places, sites, options.prefilter)
    top = radius_nearest(
        sites, near, _place_columns(with_geometry), limit, most, _criteria(), options
    ).withColumn("found", F.lit(True))
    answers = answer_points(points, top, site, suggestion)
    shape = {
        "query_id": F.col("query_id"),
        "query_lat": F.col("lat"),
        "query_lng": F.col("lng"),
        "radius_m": F.col("radius_m"),
        "category": F.col("category"),
        "count": F.coalesce("count", F.lit(0)),
        "rank": F.col("rank"),
        "id": F.col("id"),
        "name": F.col("name"),
        "lat": F.col("place_lat"),
        "lng": F.col("place_lng"),
        "distance_m": whole_metres(F.col("distance")),
        **{
            c: F.col(c)
            for c in ("confidence", "address", "phone", "website", "brand")
        },
    }
    if with_geometry:
        shape |= shaping.geometry_columns(
            F.col("include_geometry"),
            shaping.PLACE_GEOMETRY_NOTE,
            options.limits.geometry_text_cap,
        )
    made = answers.select(
        *[c.alias(n) for n, c in shape.items()], F.col("suggestion")
    )
    return with_data_version(made, options.data_version)


def places_in_radius(
    points: DataFrame,
    places: Layer,
    taxonomy: DataFrame,
    options: RadiusOptions = DEFAULT_OPTIONS,
) -> DataFrame:
    """Places of a category within ``radius_m``, nearest first, up to ``limit``.

    Permanently closed places are left out unless ``include_closed``.  One row per
    place, numbered by ``rank``; points without a match keep one row with a suggestion.
    """
    accepted = accepted_points(points, "places_in_radius", taxonomy, options.limits)
    # Wording of the suggestion.
    suggestion = F.concat(
        F.lit("No "), F.col("category"), F.lit(" found within "),
        F.col("radius_m").cast("string"),
        F.lit("m. Try increasing radius or check category with get_place_categories."),
    )
    return _search(
        accepted,
        places,
        F.col("limit"),
        options.limits.max_results,
        "include_geometry" in points.columns,
        suggestion,
        options,
    )


def nearest_place_of_type(
    points: DataFrame,
    places: Layer,
    taxonomy: DataFrame,
    options: RadiusOptions = DEFAULT_OPTIONS,
) -> DataFrame:
    """The closest place of a category within ``max_radius_m`` (5000 when not given)."""
    accepted = accepted_points(points, "nearest_place_of_type", taxonomy, options.limits)
    # Wording of the suggestion.
    suggestion = F.concat(
        F.lit("No "), F.col("category"), F.lit(" found within "),
        F.col("radius_m").cast("string"), F.lit("m. Try increasing max_radius_m."),
    )
    return _search(
        accepted,
        places,
        F.lit(1),
        1,
        "include_geometry" in points.columns,
        suggestion,
        options,
    ).drop("rank").withColumnRenamed("radius_m", "max_radius_m")


def count_places_by_type_in_radius(
    points: DataFrame,
    places: Layer,
    taxonomy: DataFrame,
    options: RadiusOptions = DEFAULT_OPTIONS,
) -> DataFrame:
    """How many places of a category lie within ``radius_m``; zero counts included."""
    accepted = accepted_points(
        points, "count_places_by_type_in_radius", taxonomy, options.limits
    ).drop("include_geometry")
    site = [c for c in accepted.columns if c != "query_id"]
    near = around(places, accepted, options.prefilter)
    counts = radius_counts(
        accepted.select(*site).distinct(), near, None, _criteria(), options
    ).select(*site, "count", F.lit(True).alias("found"))
    # Wording of the suggestion.
    suggestion = F.concat(
        F.lit("Zero "), F.col("category"), F.lit(" found within "),
        F.col("radius_m").cast("string"),
        F.lit("m. This may indicate sparse coverage in this region, or try a larger radius."),
    )
    made = answer_points(accepted, counts, site, suggestion).select(
        "query_id",
        F.col("lat").alias("query_lat"),
        F.col("lng").alias("query_lng"),
        "radius_m",
        "category",
        F.coalesce("count", F.lit(0)).alias("count"),
        "suggestion",
    )
    return with_data_version(made, options.data_version)


#: Length of the pieces that texts are looked up by; shorter texts have shorter pieces.
_GRAM = 3


def _grams(text: str, sizes: str) -> str:
    """All substrings of the given sizes, as SQL text."""
    pieces = f"transform(sequence(1, length({text}) - g + 1), i -> substring({text}, i, g))"
    return f"flatten(transform(filter({sizes}, g -> g <= length({text})), g -> {pieces}))"


def _lookups(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that contain a text: ``_text`` and ``position``.

    An inverted index leads from pieces of one to three characters to the entries they
    occur in.  Each text is looked up by the rarest of its pieces only, and what is found
    is compared with the whole text."""
    sizes = f"sequence(1, {_GRAM})"
    occurring = F.expr(f"array_distinct(concat({_grams('_name', sizes)}, {_grams('_told', sizes)}))")
    index = entries.select(F.explode(occurring).alias("gram"), "position", "_name", "_told")
    sizes_known = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.expr(f"array_distinct({_grams('_text', f'array(least(length(_text), {_GRAM}))')})")
    wanted = texts.select("_text", F.explode(own).alias("gram"))
    # a piece that occurs nowhere is the rarest: nothing is looked up then
    rarest = wanted.join(sizes_known, "gram", "left").groupBy("_text").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram")
    )
    found = balanced_join(rarest, index, ["gram"], ["_text"], ["position"])
    holds = F.contains("_name", F.col("_text")) | F.contains("_told", F.col("_text"))
    return found.where(holds).select("_text", "position")


def category_catalog(
    searches: DataFrame,
    taxonomy: DataFrame,
    places: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Taxonomy entries whose category or description contains a search text.

    ``searches`` has ``query_id`` and ``query``.  The match ignores case and takes the
    text literally; a missing or blank text matches everything.  Entries keep taxonomy
    order; with ``limit``, the first so many of each search are returned.  With ``places``
    each entry also gets the number of places of that category.  Searches for the same text
    are answered once.
    """
    query = F.nullif(stripped(F.col("query")), F.lit(""))
    cleaned = searches.select(
        "query_id", query.alias("query"), F.coalesce(F.lower(query), F.lit("")).alias("_text")
    )
    entries = taxonomy.select(
        "position",
        "category",
        "description",
        F.lower("category").alias("_name"),
        F.lower(F.coalesce("description", F.lit(""))).alias("_told"),
    )
    found = _lookups(cleaned.where("_text <> ''").select("_text").distinct(), entries)
    found = found.unionByName(entries.select(F.lit("").alias("_text"), "position"))
    ranked = found.withColumn(
        "rank", F.row_number().over(W.partitionBy("_text").orderBy("position"))
    )
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    listed = ranked.join(entries.select("position", "category", "description"), "position")
    answers = balanced_attach(cleaned, listed.drop("position"), ["_text"], ["query_id"])
    answers = answers.select("query_id", "query", "rank", "category", "description")
    if places is None:
        return answers
    observed = places.groupBy(F.col("categories.primary").alias("category")).agg(
        F.count(F.lit(1)).alias("places")
    )
    return answers.join(observed, "category", "left").select(
        *answers.columns,
        F.when(
            F.col("category").isNotNull(), F.coalesce("places", F.lit(0))
        ).alias("places"),
    )
