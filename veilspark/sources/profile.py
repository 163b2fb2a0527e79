"""Settings of a deployment, read from YAML."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from ..functions.fixed import PROFILE


@dataclass(frozen=True)
class Profile:
    """What ``operators.engine`` goes by; the defaults are fixed values."""

    name: str = PROFILE["name"]
    languages: tuple[str, ...] = PROFILE["languages"]
    fail_mode: str = PROFILE["fail_mode"]
    never_mask: tuple[str, ...] = PROFILE["never_mask"]
    token_instruction: bool = PROFILE["token_instruction"]
    alerts_on: tuple[str, ...] = PROFILE["alerts_on"]

    @staticmethod
    def of(data: dict | None) -> Profile:
        """From what a YAML file holds: ``profile`` is the name, ``alerts: {on: [...]}`` the alerts; unknown settings are left out."""
        data = dict(data or {})
        given = {"name": data.get("profile"), "alerts_on": (data.get("alerts") or {}).get("on")}
        given |= {f.name: data.get(f.name) for f in fields(Profile) if f.name not in given}
        given = {k: v for k, v in given.items() if v is not None}
        return Profile(**{k: tuple(v) if isinstance(PROFILE[k], tuple) else v for k, v in given.items()})

    @staticmethod
    def parse(text: str) -> Profile:
        import yaml  # an optional dependency

        return Profile.of(yaml.safe_load(text))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Profile:
        """From a file in any store that Spark reads."""
        return Profile.parse(spark.read.text(path, wholetext=True).first().value)
