"""Digests and the RFC 8785 canonical form of JSON."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def sha256_bytes(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def row_payload(*columns: Column) -> Column:
    """Columns one after the other, each as its length in characters, a colon and its text, a null as a dash.

    The lengths make the form unambiguous: no other row has the same payload, wherever its text is cut.
    """
    texts = [c.cast("string") for c in columns]
    parts = [F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in texts]
    return F.concat(*[F.coalesce(p, F.lit("-")) for p in parts])


def _number(value: float) -> str:
    """A number as ECMAScript writes it, which is what RFC 8785 asks for."""
    if not math.isfinite(value):
        raise ValueError("RFC 8785 has no form for NaN or infinity")
    if value == 0:
        return "0"
    sign = "-" if value < 0 else ""
    mantissa, _, exponent = f"{abs(value)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + ("" if part == "0" else part)).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + ("" if part == "0" else part)) - len(digits))
    digits = digits.rstrip("0")
    if len(digits) <= point <= 21:
        return sign + digits + "0" * (point - len(digits))
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    scale = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + scale


def canonical(value) -> str:
    if isinstance(value, dict):
        ordered = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v)}" for k, v in ordered) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return _number(float(value))


#: The largest whole number up to which doubles keep every one apart.
EXACT = 2**53


def _integer(digits: str) -> int:
    value = int(digits)
    if abs(value) > EXACT:
        raise ValueError("two such numbers may have one double")
    return value


def _members(pairs: list[tuple[str, object]]) -> dict:
    made = dict(pairs)
    if len(made) < len(pairs):
        raise ValueError("a key is there twice")
    return made


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


def canonical_json(text: Column) -> Column:
    """RFC 8785 form of a JSON string column; null where it has none: text that is not valid JSON, numbers beyond
    double precision, whole ones beyond 2^53, keys that an object has twice, unpaired surrogates, and nesting beyond
    what the parser takes.

    Key order by UTF-16 unit and ECMAScript numbers have no Spark function, so this one is an Arrow UDF.
    """

    @F.pandas_udf(T.StringType())
    def run(batch: pd.Series) -> pd.Series:
        def one(raw):
            try:
                if raw is None:
                    return None
                made = canonical(json.loads(raw, parse_int=_integer, parse_constant=_constant, object_pairs_hook=_members))
                made.encode()  # an unpaired surrogate has no UTF-8 form
                return made
            except (ValueError, OverflowError, RecursionError):
                return None

        return batch.map(one)

    return run(text)
