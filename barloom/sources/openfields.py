"""Payloads whose fields are not all known: typed columns for those that are, one VARIANT column for the rest.

Nothing is lost on the way in: fields that nobody has named yet are kept with their types, can be read by path later, are
counted in a census, and go back out under their own names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from barloom.functions.mathfn import first_key

Fields = Mapping[str, tuple[str, str]]

# Per message the result's column, the field it comes from and its type.
CONTRACT: Fields = {"strike": ("strike_price", "double"), "expiration": ("expiration_date", "string"), "option_type": ("contract_type", "string")}
ARTICLE: Fields = {"id": ("id", "string"), "headline": ("headline", "string"), "symbol": ("symbol", "string")}


def _name(field: str) -> str:
    """The path of a field; Spark's paths have no escapes, so a name may hold one kind of quote."""
    if "'" in field and '"' in field:
        raise ValueError(f"a path cannot name {field!r}")
    return f'$["{field}"]' if "'" in field else f"$['{field}']"


def at(column: Column | str, path: str, kind: str) -> Column:
    """The value at ``path`` ($.a.b, $.a[0]) as ``kind``; null if it is absent, null or of no such kind."""
    return F.try_variant_get(column, path, kind)


def present(column: Column | str, path: str) -> Column:
    """Whether there is a field at ``path``, be its value null; null columns have none."""
    return F.coalesce(F.try_variant_get(column, path, "variant").isNotNull(), F.lit(False))


def fields_of(column: Column | str) -> Column:
    """The fields of an object as a map; null for anything that is no object."""
    return F.try_variant_get(column, "$", "map<string,variant>")


def _rest(column: str, fields: Mapping[str, Column]) -> Column:
    """The object's map without the named fields; one whose value could not be read (``fields``: field, whether its result is null) stays in it."""
    def keep(name: Column, value: Column) -> Column:
        plain = F.lit(True)
        for source, unread in fields.items():
            plain = F.when(name == source, unread & ~F.is_variant_null(value)).otherwise(plain)
        return plain

    return F.map_filter(fields_of(column), keep) if fields else fields_of(column)


def typed(df: DataFrame, column: str, fields: Fields, extra: str = "extra", as_map: bool = False) -> DataFrame:
    """The variant ``column`` as typed columns of ``fields`` and one variant column of all else, or with ``as_map`` a map of variants.

    Values are read in a step of their own: casts out of a variant are dear, and the rest has to know which ones failed.
    """
    kept = [c for c in df.columns if c != column]
    read = {name: f"_read_{i}" for i, name in enumerate(fields)}
    values = df.select("*", *[at(column, _name(source), kind).alias(read[name]) for name, (source, kind) in fields.items()])
    unread = {source: F.col(read[name]).isNull() for name, (source, _) in fields.items()}
    rest = _rest(column, unread)
    return values.select(*kept, *[F.col(read[name]).alias(name) for name in fields], (rest if as_map else F.to_variant_object(rest)).alias(extra))


def _as_variant(name: str, kind: str) -> Column:
    return F.to_variant_object(F.col(name)) if kind.lower().startswith(("array", "map", "struct")) else F.col(name).cast("variant")


def _whole(fields: Fields, extra: str) -> Column:
    """Typed columns and the rest as one map of variants."""
    rest = F.coalesce(fields_of(extra), F.expr("CAST(map() AS MAP<STRING, VARIANT>)"))
    if not fields:
        return rest
    # Paths answer what the rest holds; within a lambda its map would be made once more for every field.
    own = [(F.lit(source), F.when(~present(extra, _name(source)), _as_variant(name, kind))) for name, (source, kind) in fields.items()]
    known = F.map_filter(F.create_map(*[x for pair in own for x in pair]), lambda _, v: v.isNotNull() & ~F.is_variant_null(v))
    return F.map_concat(known, rest)


def untyped(fields: Fields, extra: str = "extra") -> Column:
    """Typed columns and the rest as one object again; nulls are left out, a field kept in the rest is taken from there."""
    return F.to_variant_object(_whole(fields, extra))


def untyped_json(fields: Fields, extra: str = "extra") -> Column:
    """``untyped`` as JSON text, without making the object first."""
    return F.to_json(_whole(fields, extra))


def explode_items(payloads: DataFrame, items: str, value: str = "value", keep: Fields | None = None, outer: bool = False) -> DataFrame:
    """One row per element of the array at path ``items`` as variant ``item``; ``keep`` are fields of the message itself.

    Text that is no JSON counts as null.  Rows without such an array have no result, or with ``outer`` one of null.
    """
    parsed = payloads.select(F.try_parse_json(value).alias("_p"))
    explode = F.explode_outer if outer else F.explode
    return parsed.select(*[at("_p", _name(source), kind).alias(name) for name, (source, kind) in (keep or {}).items()],
                         explode(at("_p", items, "array<variant>")).alias("item"))


def open_chain(payloads: DataFrame, value: str = "value", fields: Fields = CONTRACT, as_map: bool = False) -> DataFrame:
    """``explode_chain`` with all that a contract has beside the known fields in ``extra``."""
    rows = typed(explode_items(payloads, "$.data.results", value, {"symbol": ("symbol", "string")}, outer=True), "item", fields, as_map=as_map)
    return rows.withColumn("expiration", F.to_date(F.try_to_timestamp("expiration"))) if "expiration" in fields else rows


def open_news(payloads: DataFrame, value: str = "value", fields: Fields = ARTICLE) -> DataFrame:
    """``explode_news`` with all that an article has beside the known fields in ``extra``."""
    return typed(explode_items(payloads, "$.feed", value), "item", fields).withColumn("key", first_key("id", "headline"))


def census(df: DataFrame, column: str = "extra", by: Sequence[str] = ()) -> DataFrame:
    """(by, field, kind, rows): which fields occur with which types, counted over all rows; counts are reduced before the shuffle.

    ``column`` is an object or a map of variants, which need not be taken apart first.
    """
    fields = F.col(column) if isinstance(df.schema[column].dataType, MapType) else fields_of(column)
    # For a plain explode the planner would filter on the size of the map, and make the map for that once more.
    pairs = df.select(*by, F.explode_outer(fields).alias("field", "_v")).where("field IS NOT NULL").select(*by, "field", F.schema_of_variant("_v").alias("kind"))
    return pairs.groupBy(*by, "field", "kind").agg(F.count(F.lit(1)).alias("rows"))


def as_metadata(df: DataFrame, columns: Sequence[str], into: str = "metadata") -> DataFrame:
    """``columns`` folded into one variant object; numbers keep their types, nulls are kept as nulls."""
    kept = [c for c in df.columns if c not in columns and c != into]
    return df.select(*kept, F.to_variant_object(F.struct(*columns)).alias(into))
