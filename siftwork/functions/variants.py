"""Reading loosely typed JSON held in VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftwork.functions.text import strip
from siftwork.plans.pin import let


_END = "<end of text>"


def parse(text: Column) -> Column:
    """JSON text as VARIANT, or null if it is not exactly one JSON value.

    The parser stops after the first value, so the text is read as the first item of a list with a
    known second item: anything after the value then breaks the list or moves that item.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    return let(
        listed,
        lambda v: F.when(
            F.try_variant_get(v, "$[1]", "string") == _END, F.try_variant_get(v, "$[0]", "variant")
        ),
    )


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def int_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "int")


def array_at(v: Column, path: str = "$") -> Column:
    """Elements of an array, or null for any other value."""
    return F.try_variant_get(v, path, "array<variant>")


def has(v: Column, path: str) -> Column:
    """The key exists, even with a JSON null."""
    return F.try_variant_get(v, path, "variant").isNotNull()


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    """Without a look at the fields, which a schema of the value would take."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def is_array(v: Column) -> Column:
    return array_at(v).isNotNull()


def is_whole(v: Column, path: str) -> Column:
    return F.coalesce(kind(F.try_variant_get(v, path, "variant")) == "BIGINT", F.lit(False))


def objects(arr: Column) -> Column:
    """Only the object elements; a null array becomes an empty one."""
    return F.coalesce(F.filter(arr, is_object), F.array().cast("array<variant>"))


def first_text_at(v: Column, *paths: str) -> Column:
    """First path whose text is not blank, trimmed."""
    return F.coalesce(*[F.nullif(strip(text_at(v, p)), F.lit("")) for p in paths])


# JSON text of the values that count as false.
_FALSE = r'^(?:null|false|""|\[\]|\{\}|-?0(?:[.]0*)?(?:[eE][+-]?[0-9]+)?)$'


def truthy(v: Column, path: str, default: Column) -> Column:
    """Truth of a JSON value: null, false, zero and empties are false; a missing key is ``default``."""
    item = F.to_json(F.try_variant_get(v, path, "variant"))
    return F.coalesce(~item.rlike(_FALSE), default)


def json_list(v: Column) -> Column:
    """A top-level list, or the list under ``findings`` / ``Findings``."""
    return F.when(is_array(v), array_at(v)).otherwise(
        F.coalesce(array_at(v, "$.findings"), array_at(v, "$.Findings"))
    )
