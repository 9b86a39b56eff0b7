"""Type names of the dialect as Spark types."""

from __future__ import annotations

import re

_NAMES = {
    "BOOL": "BOOLEAN", "LOGICAL": "BOOLEAN", "INT1": "TINYINT", "INT2": "SMALLINT", "SHORT": "SMALLINT", "INT16": "SMALLINT", "INTEGER": "INT", "INT4": "INT", "INT32": "INT", "SIGNED": "INT", "INTEGRAL": "INT",
    "INT8": "BIGINT", "INT64": "BIGINT", "LONG": "BIGINT", "OID": "BIGINT", "UTINYINT": "SMALLINT", "UINT8": "SMALLINT", "USMALLINT": "INT", "UINT16": "INT", "UINTEGER": "BIGINT", "UINT32": "BIGINT", "UBIGINT": "DECIMAL(20,0)", "UINT64": "DECIMAL(20,0)",
    "HUGEINT": "DECIMAL(38,0)", "INT128": "DECIMAL(38,0)", "UHUGEINT": "DECIMAL(38,0)", "UINT128": "DECIMAL(38,0)", "FLOAT4": "FLOAT", "REAL": "FLOAT", "FLOAT8": "DOUBLE", "DEC": "DECIMAL", "NUMERIC": "DECIMAL",
    "VARCHAR": "STRING", "CHAR": "STRING", "BPCHAR": "STRING", "NVARCHAR": "STRING", "TEXT": "STRING", "BLOB": "BINARY", "BYTEA": "BINARY", "VARBINARY": "BINARY", "UUID": "STRING", "JSON": "STRING",
    "TIMESTAMP": "TIMESTAMP_NTZ", "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMP_US": "TIMESTAMP_NTZ", "TIMESTAMP_MS": "TIMESTAMP_NTZ", "TIMESTAMP_S": "TIMESTAMP_NTZ", "TIMESTAMP_NS": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP", "TIME": "TIME(6)", "TIMETZ": "TIME(6)",
}
INTEGERS = frozenset(("TINYINT", "SMALLINT", "INT", "BIGINT"))


def spark_type(text: str) -> str:
    """The Spark spelling; a bare DECIMAL is (18,3)."""
    text = text.strip()
    if text.endswith("[]"):
        return f"ARRAY<{spark_type(text[:-2])}>"
    m = re.fullmatch(r"(\w+)\s*\((.*)\)", text, re.S)
    base, args = (m[1].upper(), m[2]) if m else (text.upper(), None)
    name = _NAMES.get(base, base)
    if base in ("STRUCT", "ROW") and args:
        return "STRUCT<" + ", ".join(f"{f.split(None, 1)[0].strip(chr(34))}: {spark_type(f.split(None, 1)[1])}" for f in _split(args)) + ">"
    if base == "MAP" and args:
        return "MAP<" + ", ".join(spark_type(x) for x in _split(args)) + ">"
    if base in ("LIST", "ARRAY") and args:
        return f"ARRAY<{spark_type(args)}>"
    if name == "DECIMAL":
        return f"DECIMAL({args.replace(' ', '')})" if args else "DECIMAL(18,3)"
    if base == "UNION":
        raise ValueError("Spark has no UNION type")
    return name


def _split(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c in "(<[") - (c in ")>]")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]
