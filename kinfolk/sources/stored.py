"""Saved reports and settings (SRC8, SRC9)."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kinfolk import schema

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ChatSettings:
    endpoint: str
    model: str
    max_tokens: int = 200


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """The one-row report of a saved JSON file."""
    return spark.read.schema(schema.REPORT).option("multiLine", True).json(path)


def load_settings(path: str, section: str | None = None) -> ChatSettings | None:
    """Settings of the description service: a section by name, or the first that names an endpoint and a model.

    None, with a warning, if they cannot be read.
    """
    try:
        with open(path) as f:
            every = json.load(f)
        fitting = (v for v in every.values() if isinstance(v, dict) and {"endpoint", "model"} <= v.keys())
        s = every[section] if section else next(fitting, {})
        return ChatSettings(s["endpoint"], s["model"], int(s.get("max_tokens") or 200))
    except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
        log.warning("%s: no settings: %s", path, e)
        return None
