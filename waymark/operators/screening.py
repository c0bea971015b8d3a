"""Checks on the columns of a query-point table.

Rows are never dropped here: every row gets its cleaned parameters and, when a
parameter is bad, the name of the first bad one and a message.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import literals
from waymark.functions.literals import stripped
from waymark.plans.limits import DEFAULT_LIMITS, Limits

# Accepted parameter domains, defaults and limits.
ROAD_CLASSES = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "residential",
    "service", "footway", "cycleway", "path", "track", "unclassified",
)
LAND_USE_SUBTYPES = (
    "residential", "commercial", "industrial", "institutional", "agriculture",
    "aquaculture", "recreation", "park", "forest", "cemetery", "religious",
    "military", "education", "medical", "transportation", "airport", "port",
    "dam", "quarry", "landfill", "brownfield", "greenfield",
)
TRUE_WORDS = ("true", "1", "yes")
DEFAULT_LIMIT = 20
DEFAULT_NEAREST_RADIUS_M = 5_000

# What a value that is no text is called in a message, by its type.
_TYPE_NAMES = {
    "byte": "int", "short": "int", "integer": "int", "long": "int", "float": "float",
    "double": "float", "boolean": "bool", "array": "list", "struct": "dict", "map": "dict",
    "binary": "bytes",
}


@dataclass(frozen=True)
class _Check:
    """One parameter: its cleaned value, whether it is acceptable, and the failures
    that may have to be reported, in order."""

    param: str
    cleaned: Column
    accepted: Column
    failures: Callable[[], list[tuple[Column, Column]]]


def _text(*pieces: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def _shown(df: DataFrame, name: str) -> Column:
    """The received value as it appears in a message."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        shown = literals.shown_text(value)
    elif isinstance(df.schema[name].dataType, T.BooleanType):
        shown = F.initcap(value.cast("string"))
    elif isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        shown = literals.shown_number(value.cast("double"))
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit("None"))


def _number(df: DataFrame, name: str) -> tuple[Column, Column]:
    """The value as a double, null if it is no number, and whether it is one."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return literals.number(value)
    return value.cast("double"), value.isNotNull()


def _finite(number: Column) -> Column:
    return ~F.isnan(number) & (F.abs(number) != float("inf"))


def _degrees(df: DataFrame, name: str, most: int) -> _Check:
    number, is_number = _number(df, name)
    return _Check(
        name,
        number,
        number.between(-most, most),
        lambda: [
            (~is_number, _text(f"{name} must be a number. Received: ", _shown(df, name))),
            (
                number.isNull() | ~_finite(number),
                _text(f"{name} must be a finite number. Received: ", _shown(df, name)),
            ),
            (
                ~number.between(-most, most),
                _text(
                    f"{name} must be between -{most} and {most}. Received: ",
                    literals.shown_number(number),
                ),
            ),
        ],
    )


def _whole(
    df: DataFrame,
    column: str,
    name: str,
    most: int,
    default: int | None,
    null_is_omitted: bool = True,
) -> _Check:
    """A number cut to an integer in ``1..most``.  Messages call it ``name``."""
    if column not in df.columns:
        if default is None:
            return _Check(
                name,
                F.lit(None).cast("int"),
                F.lit(False),
                lambda: [
                    (F.lit(True), F.lit(f"{name} must be a number. Received: None"))
                ],
            )
        return _Check(name, F.lit(default), F.lit(True), list)
    number, is_number = _number(df, column)
    omitted = default is not None and null_is_omitted
    missing = F.col(column).isNull() if omitted else F.lit(False)
    accepted = (number >= 1) & (number < most + 1)
    valid = accepted
    cleaned = F.floor(number).cast("int")
    if default is not None:
        cleaned = F.coalesce(cleaned, F.lit(default))
        accepted = missing | accepted
    return _Check(
        name,
        cleaned,
        accepted,
        lambda: [
            (
                ~missing & (~is_number | number.isNull() | ~_finite(number)),
                _text(f"{name} must be a number. Received: ", _shown(df, column)),
            ),
            (
                ~missing & ~valid,
                _text(
                    f"{name} must be between 1 and {most}. Received: ",
                    literals.shown_whole(number),
                ),
            ),
        ],
    )


def _word(df: DataFrame, name: str, known: Column, unknown: Column, low: bool) -> _Check:
    if name not in df.columns or not isinstance(
        df.schema[name].dataType, T.StringType
    ):
        required = F.lit(f"{name} is required and must be a non-empty string.")
        nothing = F.lit(None).cast("string")
        return _Check(name, nothing, F.lit(False), lambda: [(F.lit(True), required)])
    cleaned = stripped(F.col(name))
    cleaned = F.lower(cleaned) if low else cleaned
    return _Check(
        name,
        cleaned,
        known,
        lambda: [
            (
                F.coalesce(F.col(name), F.lit("")) == "",
                F.lit(f"{name} is required and must be a non-empty string."),
            ),
            (cleaned == "", F.lit(f"{name} must be a non-empty string.")),
            (~known, unknown),
        ],
    )


def _listed(df: DataFrame, name: str, domain: tuple[str, ...], label: str) -> _Check:
    cleaned = F.lower(stripped(F.col(name))) if name in df.columns else F.lit(None)
    unknown = _text(
        f"Unknown {label}: '", cleaned, f"'. Valid values: {', '.join(sorted(domain))}"
    )
    return _word(df, name, cleaned.isin(*domain), unknown, low=True)


def _search_text(df: DataFrame, name: str) -> _Check:
    """A text that may be missing; a blank one counts as missing."""
    kind = df.schema[name].dataType if name in df.columns else T.NullType()
    if isinstance(kind, T.StringType):
        cleaned = F.nullif(stripped(F.col(name)), F.lit(""))
        return _Check(name, cleaned, F.lit(True), list)
    nothing = F.lit(None).cast("string")
    if isinstance(kind, T.NullType):
        return _Check(name, nothing, F.lit(True), list)
    called = _TYPE_NAMES.get(kind.typeName(), kind.typeName())
    message = F.lit(f"{name} must be a string. Received: {called}")
    given = F.col(name).isNotNull()
    return _Check(name, nothing, ~given, lambda: [(given, message)])


def _flag(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(False)
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.coalesce(F.lower(value).isin(*TRUE_WORDS), F.lit(False))
    return F.coalesce(value.cast("boolean"), F.lit(False))


#: Parameters of each operator in the order in which they are checked.
OPERATOR_PARAMETERS = {
    "places_in_radius": ("lat", "lng", "radius_m", "category", "limit"),
    "nearest_place_of_type": ("lat", "lng", "category", "max_radius_m"),
    "count_places_by_type_in_radius": ("lat", "lng", "radius_m", "category"),
    "building_count_in_radius": ("lat", "lng", "radius_m"),
    "building_class_composition": ("lat", "lng", "radius_m"),
    "point_in_admin_boundary": ("lat", "lng"),
    "road_count_by_class": ("lat", "lng", "radius_m"),
    "nearest_road_of_class": ("lat", "lng", "road_class", "max_radius_m"),
    "road_surface_composition": ("lat", "lng", "radius_m"),
    "land_use_at_point": ("lat", "lng"),
    "land_use_composition": ("lat", "lng", "radius_m"),
    "land_use_search": ("lat", "lng", "radius_m", "subtype", "limit"),
    "category_catalog": ("query",),
}


def _checks(
    points: DataFrame, operator: str, taxonomy: DataFrame | None, limits: Limits
) -> tuple[DataFrame, list[_Check]]:
    params = OPERATOR_PARAMETERS[operator]
    if "category" in params and "category" in points.columns:
        if taxonomy is None:
            raise ValueError(f"{operator} needs the category taxonomy")
        known = taxonomy.select(
            F.col("category").alias("_category"), F.lit(True).alias("_known")
        ).distinct()
        points = points.join(
            known, stripped(F.col("category")) == F.col("_category"), "left"
        )
    checks = []
    for param in params:
        if param in ("lat", "lng"):
            checks.append(_degrees(points, param, 90 if param == "lat" else 180))
        elif param == "radius_m":
            checks.append(_whole(points, param, param, limits.max_radius_m, None))
        elif param == "max_radius_m":
            checks.append(
                _whole(
                    points,
                    param,
                    "radius_m",
                    limits.max_radius_m,
                    DEFAULT_NEAREST_RADIUS_M,
                    limits.null_is_omitted,
                )
            )
        elif param == "limit":
            checks.append(_whole(points, param, param, limits.max_results, DEFAULT_LIMIT))
        elif param == "category":
            unknown = _text(
                "Unknown category: '",
                stripped(F.col("category")) if "category" in points.columns else "",
                "'. Use get_place_categories to find valid categories.",
            )
            found = F.col("_known").isNotNull()
            checks.append(_word(points, param, found, unknown, low=False))
        elif param == "road_class":
            checks.append(_listed(points, param, ROAD_CLASSES, "road_class"))
        elif param == "subtype":
            checks.append(_listed(points, param, LAND_USE_SUBTYPES, "land use subtype"))
        elif param == "query":
            checks.append(_search_text(points, param))
    return points, checks


def _flags(points: DataFrame) -> list[Column]:
    return [_flag(points, f).alias(f) for f in ("include_geometry", "include_closed")]


def screen_points(
    points: DataFrame,
    operator: str,
    taxonomy: DataFrame | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Clean the parameters of ``operator`` and report bad ones.

    The result has ``query_id``, one typed column per parameter (null when bad), the
    flags ``include_geometry`` and ``include_closed``, ``error_param`` and ``error``.
    A ``max_radius_m`` is delivered as ``radius_m``.  ``taxonomy`` is needed for
    operators with a category.
    """
    points, checks = _checks(points, operator, taxonomy, limits)
    which, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for check in reversed(checks):
        for failed, text in reversed(check.failures()):
            failed = F.coalesce(failed, F.lit(False))
            which = F.when(failed, F.lit(check.param)).otherwise(which)
            message = F.when(failed, text).otherwise(message)
    return points.select(
        "query_id",
        *[F.when(c.accepted, c.cleaned).alias(c.param) for c in checks],
        *_flags(points),
        which.alias("error_param"),
        message.alias("error"),
    )


def cleaned_points(
    points: DataFrame,
    operator: str,
    taxonomy: DataFrame | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """All rows with their cleaned parameters, bad ones null, without messages."""
    points, checks = _checks(points, operator, taxonomy, limits)
    return points.select(
        "query_id",
        *[F.when(c.accepted, c.cleaned).alias(c.param) for c in checks],
        *_flags(points),
    )


def accepted_points(
    points: DataFrame,
    operator: str,
    taxonomy: DataFrame | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Rows whose parameters are all good, reduced to their cleaned parameters.

    Same decisions as :func:`screen_points`, as one plain filter without messages.
    """
    points, checks = _checks(points, operator, taxonomy, limits)
    for check in checks:
        points = points.where(check.accepted)
    return points.select(
        "query_id", *[c.cleaned.alias(c.param) for c in checks], *_flags(points)
    )


def rejected_points(
    points: DataFrame,
    operator: str,
    taxonomy: DataFrame | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Rows with an error: ``query_id``, ``error_param`` and ``error``."""
    screened = screen_points(points, operator, taxonomy, limits)
    return screened.where(F.col("error").isNotNull()).select(
        "query_id", "error_param", "error"
    )
