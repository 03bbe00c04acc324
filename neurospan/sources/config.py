"""Task configuration from YAML, validated on the driver, and the small tables that queries join."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import yaml
from pydantic import BaseModel, ConfigDict, Field
from pyspark.sql import DataFrame, SparkSession


class Condition(BaseModel):
    name: str
    event_codes: list[str | int]


class Component(BaseModel):
    name: str
    tmin: float
    tmax: float
    channels: list[str] = Field(default_factory=list)


class TaskConfig(BaseModel):
    model_config = ConfigDict(extra="allow")

    task_name: str
    conditions: list[Condition]
    erp_components: list[Component] = Field(default_factory=list)

    @classmethod
    def from_yaml(cls, text: str) -> TaskConfig:
        return cls.model_validate(yaml.safe_load(text))

    def event_codes(self) -> list[str]:
        """Codes of all conditions in order, repeated ones kept, always as text."""
        return [str(c) for x in self.conditions for c in x.event_codes]

    def condition_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.name, [str(x) for x in c.event_codes]) for c in self.conditions], "condition string, codes array<string>")


def translate_codes(codes: list[str | int], names: dict[str, str]) -> list[str]:
    return [names.get(c, c) if isinstance(c, str) else str(c) for c in codes]


def config_hash(config: dict[str, Any], digits: int = 16) -> str:
    """SHA-256 of the configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:digits]


def flatten(config: dict[str, Any], prefix: str = "") -> dict[str, str]:
    """Dotted paths to values as JSON, for comparing configurations as tables."""
    out: dict[str, str] = {}
    for key, value in config.items():
        path = f"{prefix}{key}"
        out |= flatten(value, f"{path}.") if isinstance(value, dict) and value else {path: json.dumps(value, sort_keys=True, default=str)}
    return out


def config_table(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame(sorted(flatten(config).items()), "path string, value string")
