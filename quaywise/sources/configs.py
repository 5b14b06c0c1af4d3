"""Configuration files: YAML where its library is there, JSON always."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def read_config(spark: SparkSession, path: str) -> dict:
    """The settings of a file in any store that Spark reads; a few kilobytes, read on the driver.

    Files are YAML (of which JSON is a part). Without the YAML library only JSON can be read.
    """
    text = spark.read.text(path, wholetext=True).head()[0]
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no settings")
    return found


def setting(config: dict, *names: str):  # noqa: ANN201
    """A setting by the names on the way to it; a missing one is told by its whole name."""
    at = config
    for k, name in enumerate(names):
        if not isinstance(at, dict) or name not in at:
            raise KeyError(f"no setting {'.'.join(names[: k + 1])}")
        at = at[name]
    return at
