"""Canonical JSON (RFC 8785) as Arrow-batched column functions.

Spark's own JSON functions cannot do this: they keep member order or print
numbers the Java way, and Variant drops trailing data. The helper leans on the
C parser and encoder of the standard library and lays out by hand only the
values for which their output differs from ECMAScript.
"""
from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, functions as F

from tracewright.config import INGEST, STORED, JsonProfile

_SAFE = 1 << 53
_encoder = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True, check_circular=False)
_quote = json.JSONEncoder(ensure_ascii=False).encode


class Rejected(ValueError):
    """The text is not acceptable JSON."""


def number_text(value: float) -> str:
    """ECMAScript Number::toString of a finite binary64."""
    if value == 0:
        return "0"
    sign = "-" if value < 0 else ""
    mantissa, _, exp = repr(abs(value)).partition("e")
    whole, _, frac = mantissa.partition(".")
    if frac == "0":
        frac = ""
    digits = (whole + frac).lstrip("0")
    point = len(whole) + int(exp or 0) - (len(whole + frac) - len(digits))
    digits = digits.rstrip("0") or "0"
    if 21 < point or point <= -6:
        exponent = point - 1
        tail = "." + digits[1:] if len(digits) > 1 else ""
        return f"{sign}{digits[0]}{tail}e{'+' if exponent > 0 else '-'}{abs(exponent)}"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    if point >= len(digits):
        return sign + digits + "0" * (point - len(digits))
    return f"{sign}{digits[:point]}.{digits[point:]}"


class StrictJson:
    """One parser per profile and Python worker."""

    def __init__(self, profile: JsonProfile):
        self.profile = profile
        self._plain = True       # the C encoder prints the tree canonically
        self._decoder = json.JSONDecoder(
            object_pairs_hook=self._members, parse_float=self._real, parse_int=self._whole,
            parse_constant=self._constant)

    def _members(self, pairs):
        tree = dict(pairs)
        if len(tree) != len(pairs):
            raise Rejected("duplicate member name")
        return tree

    def _constant(self, name):
        raise Rejected(f"invalid literal {name}")

    def _whole(self, literal):
        if self.profile.safe_numbers and (len(literal) > 40 or abs(int(literal)) > _SAFE):
            raise Rejected(f"integer {literal} cannot be represented exactly; send it as a string")
        return self._keep(float(literal), literal)

    def _real(self, literal):
        value = float(literal)
        if self.profile.safe_numbers:
            if abs(value) > _SAFE:
                raise Rejected(f"number {literal} exceeds 2^53 in magnitude; send large values as strings")
            if value == 0 and literal.lower().partition("e")[0].strip("-0."):
                raise Rejected(f"number {literal} underflows to zero")
        return self._keep(value, literal)

    def _keep(self, value, literal):
        if math.isinf(value):
            raise Rejected(f"number {literal} is outside the binary64 range")
        if value.is_integer() and -_SAFE <= value <= _SAFE:
            return int(value)
        # the C encoder writes integral floats with a fraction and exponents its own way
        if value.is_integer() or not 1e-4 <= abs(value) < 1e16:
            self._plain = False
        return value

    def parse(self, raw: bytes):
        """Return (tree, plain); raise Rejected."""
        try:
            text = raw.decode("utf-8")
            self._plain = True
            tree = self._decoder.decode(text) if text[:1] != "﻿" else self._constant("U+FEFF")
        except UnicodeDecodeError:
            raise Rejected("invalid UTF-8 in string") from None
        except RecursionError:
            raise Rejected(f"nesting depth exceeds {self.profile.max_depth}") from None
        except json.JSONDecodeError as err:
            raise Rejected(f"{err.msg} (at character {err.pos})") from None
        if raw.count(b"{") + raw.count(b"[") > self.profile.max_depth and _depth(tree) > self.profile.max_depth:
            raise Rejected(f"nesting depth exceeds {self.profile.max_depth}")
        plain = self._plain
        if b"\\u" in raw:
            self._check_escapes(tree)
            plain = False
        elif not text.isascii() and max(text) > "￿":
            plain = False
        return tree, plain

    def _check_escapes(self, tree):
        for text in _strings(tree):
            if self.profile.disallow_nul and "\0" in text:
                raise Rejected("U+0000 is not allowed in strings")
            if any("\ud800" <= ch <= "\udfff" for ch in text):
                raise Rejected("unpaired surrogate")

    @staticmethod
    def encode(tree, plain: bool) -> str:
        return _encoder.encode(tree) if plain else dump(tree)

    def canonical(self, raw: bytes) -> str:
        return self.encode(*self.parse(raw))


def _depth(tree) -> int:
    level, frontier = 0, [tree]
    while frontier := [n for n in frontier if isinstance(n, (dict, list))]:
        level += 1
        frontier = [c for n in frontier for c in (n.values() if isinstance(n, dict) else n)]
    return level


def _strings(tree):
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            yield node
        elif isinstance(node, dict):
            stack.extend(node.keys())
            stack.extend(node.values())
        elif isinstance(node, list):
            stack.extend(node)


def dump(tree) -> str:
    """Canonical text of any parsed tree: members in UTF-16 order."""
    if isinstance(tree, dict):
        names = sorted(tree, key=lambda n: n.encode("utf-16-be"))
        return "{" + ",".join(f"{_quote(n)}:{dump(tree[n])}" for n in names) + "}"
    if isinstance(tree, list):
        return "[" + ",".join(map(dump, tree)) + "]"
    if isinstance(tree, str):
        return _quote(tree)
    if isinstance(tree, float):
        return number_text(tree)
    return "null" if tree is None else str(tree).lower()


def canonicalize(col: Column, profile: JsonProfile = STORED) -> Column:
    """struct(canonical, error): exactly one of the two is set for non-null input."""

    @F.pandas_udf("canonical string, error string")
    def run(raw: pd.Series) -> pd.DataFrame:
        reader = StrictJson(profile)
        good, bad = [], []
        for value in raw:
            text = error = None
            if value is not None:
                try:
                    text = reader.canonical(bytes(value))
                except Rejected as err:
                    error = str(err)
            good.append(text)
            bad.append(error)
        return pd.DataFrame({"canonical": pd.Series(good, dtype=object), "error": pd.Series(bad, dtype=object)})

    # Bytes, not text: invalid UTF-8 has to reach the parser to be reported.
    return run(col.cast("binary"))


def request_hash(col: Column) -> Column:
    """SHA-256 of the canonical request body: equal for any formatting of it."""
    return F.sha2(canonicalize(col, INGEST)["canonical"], 256)


def json_string(col: Column) -> Column:
    """A text column as a canonical JSON string literal, JVM side.

    The named escapes are plain replacements; other control characters are rare
    and take the slow branch.
    """
    out = col
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"),
                           ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    spelled = F.array_join(F.transform(F.split(out, ""), lambda ch: F.when(
        (ch != "") & (F.ascii(ch) < 32), F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(ch)), 2, "0"))))
        .otherwise(ch)), "")
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), spelled).otherwise(out), F.lit('"'))
