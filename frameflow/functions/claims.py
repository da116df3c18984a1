"""Claims of signed tokens (three base64url parts, the second one JSON). Signatures aren't checked here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAIMS = "sub string, jti string, iat double, exp double, tier string, machine_id string, plugins array<string>, seats_used int, seats_max int, user_id string, last_online_at double"
# The claims that each kind of token must have.
TOKEN = ("sub", "jti", "iat", "exp", "tier", "machine_id")
ATTESTATION = ("user_id", "machine_id", "last_online_at", "iat")


def from_base64url(text: Column) -> Column:
    """Text of unpadded base64url; null where it isn't that."""
    plain = F.translate(text, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.when(text.rlike("^[A-Za-z0-9_-]+$") & (F.length(text) % 4 != 1), F.decode(F.unbase64(padded), "UTF-8"))


def to_base64url(text: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def claims(token: Column) -> Column:
    """The payload's claims as a struct; null for what isn't three parts, or no JSON in the second."""
    parts = F.split(token, r"\.")
    return F.from_json(F.when(F.size(parts) == 3, from_base64url(F.get(parts, F.lit(1)))), CLAIMS, {"mode": "PERMISSIVE"})


def problem(found: Column, required: tuple[str, ...] = TOKEN, now: Column | None = None) -> Column:
    """What is wrong with claims: 'malformed', 'missing <claim>' (the first one), 'expired' where ``now`` (seconds) is given;
    null if nothing."""
    missing = [F.when(found[c].isNull(), F.lit(f"missing {c}")) for c in required]
    late = [] if now is None else [F.when(found["exp"] <= now, F.lit("expired"))]
    nothing = F.greatest(*[found[c].isNotNull().cast("int") for c in ("sub", "jti", "iat", "exp", "tier", "machine_id", "user_id", "last_online_at")]) == 0
    return F.when(found.isNull() | nothing, F.lit("malformed")).otherwise(F.coalesce(*missing, *late))
