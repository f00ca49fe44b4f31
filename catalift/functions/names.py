"""Identifier quoting and the place for intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def quoted_parts(*parts: str) -> str:
    """A dotted name from parts that may themselves hold any character."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def quoted(name: str) -> str:
    """Backquote every part of a dotted name; a name that is already quoted is kept."""
    return name if "`" in name else quoted_parts(*name.split("."))


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path below the folder the session names in ``spark.checkpoint.dir``.

    Every executor must see the path, so a machine-local folder is used only by a local
    session that names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="catalift-")
    return f"{base.rstrip('/')}/catalift-{uuid.uuid4().hex}"
