"""One text for a nested value, as Python's ``json.dumps(value, sort_keys=True)`` writes it, and its digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def _char(c: Column) -> Column:
    """A character in ASCII; one beyond the basic plane is two halves."""
    code = F.ascii(c)
    beyond = code - 0x10000
    halves = F.concat(_unit(0xD800 + F.shiftright(beyond, 10)), _unit(0xDC00 + beyond.bitwiseAND(0x3FF)))
    plain = F.when((code >= 32) & (code < 127), c).when(code < 0x10000, _unit(code)).otherwise(halves)
    for mark, short in SHORT.items():
        plain = F.when(c == F.lit(mark), F.lit(short)).otherwise(plain)
    return plain


def json_string(text: Column) -> Column:
    odd = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), _char), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r'[^\x20-\x7e]|["\\]'), odd).otherwise(text), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """Objects by their keys in order, nothing but ASCII; doubles from 0.001 up to 10^7, and 0, are written as Python writes them."""
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f'"{f.name}": '), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.concat(json_string(e["key"]), F.lit(": "), canonical_json(e["value"], kind.valueType))
        ordered = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k.alias("key"), F.element_at(value, k).alias("value")))
        text = F.concat(F.lit("{"), F.array_join(F.transform(ordered, pair), ", "), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    else:
        text = json_string(value) if isinstance(kind, T.StringType) else value.cast("string")
    return F.when(value.isNull(), "null").otherwise(text)


def digest(value: Column, kind: T.DataType) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical_json(value, kind), 256)
