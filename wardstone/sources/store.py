"""Stored state of the control plane: documents of instances in an append-only table of versions."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wardstone.errors import Code, GovernanceError
from wardstone.operators.catalog import Grant
from wardstone.plans.policy import Policy, dump_policies, load_policies, merge_policies


class Store:
    """Policies and grants by instance. Saving adds a version; the last one counts, earlier ones stay readable.

    Writers of one instance are not coordinated: of two that save the same version number, reading refuses."""

    SCHEMA = "kind string, instance string, version int, saved timestamp, document string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self, kind: str, instance: str) -> list:
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
            found = rows.where((F.col("kind") == kind) & (F.col("instance") == instance)).select("version", "document").collect()
        except AnalysisException:  # nothing was ever saved
            return []
        if len({r.version for r in found}) < len(found):
            raise GovernanceError(Code.CONFIG_ERROR, f"{kind} of {instance}: a version was saved twice")
        return sorted(found)

    def _save(self, kind: str, instance: str, document: str) -> int:
        version = max((r.version for r in self._versions(kind, instance)), default=0) + 1
        rows = self.spark.createDataFrame([(kind, instance, version, document)], "kind string, instance string, version int, document string")
        rows.select("kind", "instance", "version", F.current_timestamp().alias("saved"), "document").coalesce(1).write.mode("append").parquet(self.path)
        return version

    def _load(self, kind: str, instance: str, version: int | None) -> str | None:
        found = [r for r in self._versions(kind, instance) if version in (None, r.version)]
        if version is not None and not found:
            raise GovernanceError(Code.POLICY_INSTANCE_NOT_FOUND, f"{kind} of {instance}, version {version}")
        return found[-1].document if found else None

    def policies(self, instance: str, version: int | None = None) -> list[Policy]:
        text = self._load("policies", instance, version)
        return load_policies(text) if text else []

    def save_policies(self, instance: str, policies: list[Policy]) -> int:
        return self._save("policies", instance, dump_policies(policies))

    def import_policies(self, instance: str, text: str) -> dict[str, list[str]]:
        """Update or create by name; a new version only if something changes."""
        merged, report = merge_policies(self.policies(instance), load_policies(text))
        if report["created"] or report["updated"]:
            self.save_policies(instance, merged)
        return report

    def grants(self, instance: str, version: int | None = None) -> set[Grant]:
        text = self._load("grants", instance, version)
        return {Grant(**g) for g in json.loads(text)} if text else set()

    def save_grants(self, instance: str, grants: set[Grant]) -> int:
        return self._save("grants", instance, json.dumps([asdict(g) for g in sorted(grants)]))
