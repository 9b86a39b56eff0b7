"""The few functions that Spark SQL has no expression for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import json
import math
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def damerau(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbours counts once (optimal string alignment)."""
    two, one, row = [], [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, one, row = one, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
    return row[-1]


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                first.append(x)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [y for y, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(first, second)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j) if j > 0.7 else j


def jaccard(a: str, b: str) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def merge_patch(a: str, b: str) -> str:
    def go(t, p):
        if not isinstance(p, dict):
            return p
        t = dict(t) if isinstance(t, dict) else {}
        for k, v in p.items():
            t.pop(k, None) if v is None else t.__setitem__(k, go(t.get(k), v))
        return t

    return json.dumps(go(json.loads(a), json.loads(b)), separators=(",", ":"), ensure_ascii=False)


def json_contains(a: str, b: str) -> bool:
    def has(x, y) -> bool:
        if x == y and type(x) is type(y):
            return True
        if isinstance(x, dict) and isinstance(y, dict):
            if all(k in x and has(x[k], v) for k, v in y.items()):
                return True
        if isinstance(x, list) and isinstance(y, list) and all(any(has(i, j) for i in x) for j in y):
            return True
        return any(has(i, y) for i in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()))

    return has(json.loads(a), json.loads(b))


def strip_accents(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


_ROWS = {
    "damerau": (damerau, "bigint", 2), "jaro": (jaro, "double", 2), "jaro_winkler": (jaro_winkler, "double", 2), "jaccard": (jaccard, "double", 2), "json_merge": (merge_patch, "string", 2), "json_contains": (json_contains, "boolean", 2),
    "json_pretty": (lambda s: json.dumps(json.loads(s), indent=4, ensure_ascii=False), "string", 1), "strip_accents": (strip_accents, "string", 1), "nfc": (lambda s: unicodedata.normalize("NFC", s), "string", 1), "gamma": (math.gamma, "double", 1), "lgamma": (math.lgamma, "double", 1),
    "gcd": (math.gcd, "bigint", 2), "lcm": (math.lcm, "bigint", 2), "nextafter": (lambda a, b: float(np.nextafter(a, b)), "double", 2),
}


def register(spark: SparkSession) -> None:
    """Registers all under tessera_<name>; a null argument gives null."""
    for name, (f, kind, n) in _ROWS.items():
        udf = F.pandas_udf((_one if n == 1 else _two)(f), kind)
        spark.udf.register(f"tessera_{name}", udf)


def _one(f):
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x != x else f(x) for x in a], dtype=object)

    return run


def _two(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or x != x or y != y else f(x, y) for x, y in zip(a, b)], dtype=object)

    return run
