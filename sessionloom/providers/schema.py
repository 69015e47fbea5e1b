"""Replies against declared fields and types."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructType

_INTEGERS = {IntegerType: 31, LongType: 63}


def mismatch(value, kind: DataType, path: str = "") -> str | None:
    """Where and how a JSON value is not of a type: the first such place, None if there is none.

    Fields that are missing or null are right unless they are declared NOT
    NULL; those that are not declared count for nothing. A whole number is a
    double too, but neither a text nor a truth value is a number.
    """
    if isinstance(kind, StructType):
        if not isinstance(value, dict):
            return _wrong(path, "an object", value)
        for field in kind:
            inner, at = value.get(field.name), f"{path}.{field.name}" if path else field.name
            if inner is None:
                if not field.nullable:
                    return f"{at} is missing"
            elif found := mismatch(inner, field.dataType, at):
                return found
        return None
    if isinstance(kind, (ArrayType, MapType)):
        listed = isinstance(kind, ArrayType)
        if not isinstance(value, list if listed else dict):
            return _wrong(path, "a list" if listed else "an object", value)
        inner = kind.elementType if listed else kind.valueType
        items = enumerate(value) if listed else value.items()
        return next((found for k, x in items if x is not None and (found := mismatch(x, inner, f"{path}[{k}]" if listed else f"{path}.{k}"))), None)
    if isinstance(kind, StringType):
        return None if isinstance(value, str) else _wrong(path, "a text", value)
    if isinstance(kind, BooleanType):
        return None if isinstance(value, bool) else _wrong(path, "true or false", value)
    bits = _INTEGERS.get(type(kind))
    if bits:
        whole = isinstance(value, int) and not isinstance(value, bool) and -(2**bits) <= value < 2**bits
        return None if whole else _wrong(path, "a whole number", value)
    if isinstance(kind, (DoubleType, FloatType)):
        return None if isinstance(value, (int, float)) and not isinstance(value, bool) else _wrong(path, "a number", value)
    raise TypeError(f"{path or 'the reply'}: replies are not declared as {kind.simpleString()}")


def _wrong(path: str, wanted: str, value) -> str:
    return f"{path or 'the reply'} must be {wanted}, not {type(value).__name__}"
