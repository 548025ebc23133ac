"""Registered queries of the library, apart from the optional corpus operators."""

from __future__ import annotations

import importlib
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

FLAGSHIP = "resolve_chain"
MODULES: tuple[str, ...] = ("event_queries", "catalog_queries", "media_queries", "file_queries", "sound_queries", "service_queries")


def _gathered(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"wavecrate.plans.{name}"), attribute)
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("ORACLE")


def reach_workers(spark: SparkSession, root: str) -> None:
    """Ships the package to Python workers once per session unless PYTHONPATH has it already."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root in map(os.path.abspath, filter(None, paths)) or getattr(spark.sparkContext, "_wavecrate_shipped", False):
        return
    folder = tempfile.mkdtemp()
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/wavecrate", "zip", root, "wavecrate"))
    spark.sparkContext._wavecrate_shipped = True
