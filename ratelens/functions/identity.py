"""Deterministic hashes: seeded uniforms and configuration fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelens import policy
from ratelens.functions.text import col


def unit_hash(seed: Column | str, label: Column) -> Column:
    """Uniform in [0, 1) from the first eight bytes of a SHA-256."""
    text = F.concat_ws(":", F.lit(policy.UNIT_HASH_PREFIX), col(seed).cast("string"), label)
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10)
    return head.cast("double") / F.lit(2.0**64)


def fingerprint(fields: dict[str, Column | str]) -> Column:
    """SHA-256 of the JSON of ``fields`` in key order; NULLs are part of the identity."""
    record = F.struct(*[col(fields[name]).alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def measurement_key(source: Column | str, start: Column | str, duration: Column | str,
                    settings: dict[str, Column | str]) -> Column:
    """Identity of one measured window: coordinates and settings, never its list position."""
    return fingerprint({"source": source, "start": start, "duration": duration, **settings})


def policy_key(measurement: Column | str, settings: dict[str, Column | str]) -> Column:
    """Identity of a decision: a measurement plus the policy it was judged under."""
    return fingerprint({"measurement": measurement, **settings})
