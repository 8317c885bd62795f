"""Allowlist source (O2). The allowlist is a small configuration table: read it from Parquet/JSON/CSV with
the declared schema, or build it from YAML text ``{entries: [...]}`` on the driver (a handful of rows).
Dates stay strings. Entry order in the file becomes ``entry_index``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S


class AllowlistSourceError(ValueError):
    pass


def from_rows(spark: SparkSession, rows) -> DataFrame:
    """rows: sequence of dicts (or tuples domain, purpose, ttl_class, added_at) in file order."""
    out = []
    for i, r in enumerate(rows):
        if isinstance(r, dict):
            vals = [r.get(k) for k in ("domain", "purpose", "ttl_class", "added_at")]
        else:
            vals = list(r)
        out.append((i, *[None if v is None else str(v) if not isinstance(v, str) else v for v in vals]))
    return spark.createDataFrame(out, S.ALLOWLIST)


def from_yaml_text(spark: SparkSession, text: str) -> DataFrame:
    """Parse the YAML convenience format; raise on the shape errors the service reports."""
    try:
        import yaml  # optional dependency
    except ImportError as e:  # pragma: no cover
        raise AllowlistSourceError("PyYAML is not installed; load the allowlist as a table instead") from e
    try:
        parsed = yaml.load(text, Loader=yaml.BaseLoader)  # BaseLoader keeps dates as strings
    except yaml.YAMLError as e:
        raise AllowlistSourceError(f"yaml parse error: {e}") from e
    if not isinstance(parsed, dict) or "entries" not in parsed:
        raise AllowlistSourceError('top-level "entries" key missing')
    entries = parsed["entries"]
    if not isinstance(entries, list):
        raise AllowlistSourceError('"entries" is not an array')
    if not entries:
        raise AllowlistSourceError('"entries" is empty')
    for i, e in enumerate(entries):
        if not isinstance(e, dict):
            raise AllowlistSourceError(f"entry {i} is not an object")
    return from_rows(spark, entries)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(S.ALLOWLIST).load(path)


def from_yaml_file(spark: SparkSession, path: str) -> DataFrame:
    """Read a small YAML allowlist file from the driver's filesystem (configuration, not data)."""
    try:
        with open(path, encoding="utf-8") as fh:
            text = fh.read()
    except OSError as e:
        raise AllowlistSourceError(f"cannot read {path}: {e}") from e
    return from_yaml_text(spark, text)
