"""Type promotion between element types, by the engine's own names."""

from __future__ import annotations

#: Names of element types and the Spark types that hold them.
SPARK = {
    "bool": "boolean", "uint8": "smallint", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint64": "decimal(20,0)",
    "float32": "float", "float64": "double", "bigint": "decimal(38,0)", "str": "string",
}
_SIGNED = ["int8", "int16", "int32", "int64"]
_FLOATS = ["float32", "float64"]


def result_type(a: str, b: str) -> str:
    """The type of an operation's result; int64 with uint64 is float64."""
    if a == b:
        return a
    if "str" in (a, b):
        raise TypeError("text takes part in no arithmetic")
    if "bool" in (a, b):
        return b if a == "bool" else a
    if a in _FLOATS or b in _FLOATS:
        if "bigint" in (a, b):
            return "float64"
        wide = [x for x in (a, b) if x not in ("float32", "int8", "int16", "uint8")]
        return "float64" if wide else "float32"
    if "bigint" in (a, b):
        return "bigint"
    if a in _SIGNED and b in _SIGNED:
        return max(a, b, key=_SIGNED.index)
    if "uint64" in (a, b):
        other = b if a == "uint64" else a
        return "uint64" if other == "uint8" else "float64"
    other = b if a == "uint8" else a
    return "int16" if other == "int8" else other


def can_cast(a: str, b: str) -> bool:
    """Whether no value of a is changed in b."""
    try:
        return a == b or result_type(a, b) == b
    except TypeError:
        return b == "str"


def of_int(value: int) -> str:
    """The element type that an integer is stored as."""
    if -(1 << 63) <= value < 1 << 63:
        return "int64"
    return "uint64" if 0 <= value < 1 << 64 else "bigint"


def spark_type(name: str) -> str:
    return SPARK[name]
