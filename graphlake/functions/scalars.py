"""Scalar expressions shared by the operators. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + F.lit(0.5))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4.0)).cast("int")


def xml_escape(text: Column) -> Column:
    for what, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(what), F.lit(by))
    return text


def dirname(path: Column) -> Column:
    """What stands before the last slash; "." without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1))


def normal_path(path: Column) -> Column:
    """"." and ".." steps resolved; steps above the top stay."""
    up = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, step: F.when(step.isin("", "."), acc)
        .when((step == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(step))),
    )
    return F.array_join(up, "/")


def judge_score(severity: Column, blast: Column, churn: Column, confidence: Column, effort: Column) -> Column:
    weight = F.when(effort == "S", 1.15).when(effort == "L", 0.85).otherwise(1.0)
    raw = severity * (1 + F.log2(1 + blast.cast("double"))) * (1 + F.log10(1 + churn.cast("double"))) * confidence * weight * 10
    return js_round(raw).cast("long")


def priority(score: Column, agent: Column, severity: Column) -> Column:
    return F.when((agent == "security") & (severity >= 4), "P0").when(score >= 70, "P0").when(score >= 40, "P1").when(score >= 20, "P2").otherwise("P3")


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either norm is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))


def live_at(at: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open validity; no end is open."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))


def stable_id(key: str) -> str:
    """26 letters of Crockford's base 32 of the first 16 bytes of a SHA-256."""
    n = int.from_bytes(hashlib.sha256(key.encode()).digest()[:16], "big")
    return "".join("0123456789ABCDEFGHJKMNPQRSTVWXYZ"[n >> 5 * i & 31] for i in reversed(range(26)))


def candidate_score(evidence: Column, verification: Column, risk: Column, hard_fail: Column) -> Column:
    return F.when(hard_fail, F.lit("-Infinity").cast("double")).otherwise(0.4 * evidence + 0.4 * verification - 0.2 * risk)
