"""Providers of chat models from a YAML file: checked, and as a relation."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.operators.gateway import endpoint_problem

# The formats that an endpoint can speak, and ways to sign a request.
DIALECTS = ("anthropic", "openai", "responses")
AUTH = ("passthrough", "api_key")
_FIELDS = "name string, auth string, api_key_env string, endpoints map<string,string>, model_map map<string,string>, active boolean, fallback_pos int"


class ProviderError(ValueError):
    """A provider file that can't be used."""


@dataclass
class Providers:
    active: str
    fallback: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    def relation(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, _FIELDS)


def parse_providers(content: str) -> Providers:
    """A checked file: the active provider and the fallbacks have to be there, each provider has an endpoint."""
    try:
        file = yaml.safe_load(content)
    except yaml.YAMLError as e:
        raise ProviderError(f"no YAML: {e}") from e
    if not isinstance(file, dict) or not isinstance(file.get("providers"), dict) or not file["providers"]:
        raise ProviderError("providers are missing")
    active, fallback, rows = file.get("active"), file.get("fallback") or [], []
    for name in [active, *fallback]:
        if name not in file["providers"]:
            raise ProviderError(f"provider {name} is not defined")
    for name, given in file["providers"].items():
        endpoints = given.get("endpoints") if isinstance(given, dict) else None
        if not isinstance(endpoints, dict) or not endpoints or not set(endpoints) <= set(DIALECTS):
            raise ProviderError(f"provider {name}: endpoints")
        if given.get("auth", "passthrough") not in AUTH or (given.get("auth") == "api_key" and not given.get("api_key_env")):
            raise ProviderError(f"provider {name}: auth")
        at = fallback.index(name) if name in fallback else None
        rows.append((name, given.get("auth", "passthrough"), given.get("api_key_env"), endpoints, given.get("model_map") or {}, name == active, at))
    return Providers(active, fallback, rows)


def load_providers(spark: SparkSession, path: str) -> DataFrame:
    """The relation of the one file at path, read by Spark, with problem: why an endpoint may not be called, or ok."""
    content = spark.read.text(path, wholetext=True).first()
    if content is None:
        raise ProviderError(f"{path} is empty")
    rows = parse_providers(content[0]).relation(spark)
    problems = F.filter(F.transform(F.map_values("endpoints"), lambda u: endpoint_problem(u)), lambda p: p != "ok")
    return rows.withColumn("problem", F.coalesce(F.get(problems, F.lit(0)), F.lit("ok")))
