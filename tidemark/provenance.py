"""What a result was made with, kept as a JSON document beside it: session, code, packages, configuration, machine.

Each heading is a probe; a probe that fails leaves its error under its heading and stops nothing.
"""

from __future__ import annotations

import getpass
import importlib.metadata
import logging
import logging.handlers
import os
import platform
import subprocess
from collections.abc import Callable, Mapping
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from tidemark.config import Config
from tidemark.sources.store import write_json

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy", "duckdb", "PyYAML")
#: Settings of a session on which results or their speed depend.
SETTINGS = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.checkpoint.dir")
#: Folders, each under the root unless its environment variable names another.
FOLDERS = {"root": "TIDEMARK_ROOT", "data": "TIDEMARK_DATA", "reports": "TIDEMARK_REPORTS", "logs": "TIDEMARK_LOGS"}


def folder(kind: str) -> Path:
    """root, data, reports or logs."""
    if chosen := os.environ.get(FOLDERS[kind]):
        return Path(chosen)
    return Path(__file__).resolve().parents[1] if kind == "root" else folder("root") / kind


def of_session(spark: SparkSession) -> dict[str, Any]:
    """Spark's version, master and application, its parallelism, and the settings that matter."""
    context = spark.sparkContext
    facts = {"version": spark.version, "master": context.master, "application": context.applicationId, "parallelism": context.defaultParallelism}
    return facts | {"settings": {k: spark.conf.get(k, None) for k in SETTINGS}}


def of_code(root: Path | None = None) -> dict[str, Any]:
    """Commit, branch and number of changed files, as one porcelain listing tells them."""
    listing = subprocess.run(["git", "-C", str(root or folder("root")), "status", "--porcelain=v2", "--branch"], capture_output=True, text=True, timeout=20, check=True).stdout
    heads = dict(line[len("# branch.") :].split(" ", 1) for line in listing.splitlines() if line.startswith("# branch."))
    return {"commit": heads["oid"], "branch": heads["head"], "changed": sum(not line.startswith("#") for line in listing.splitlines())}


def of_packages() -> dict[str, str | None]:
    """Installed versions; null for a package that is absent."""
    installed = {d.name.lower(): d.version for d in importlib.metadata.distributions()}
    return {p: installed.get(p.lower()) for p in PACKAGES}


def of_configuration(config: Config) -> dict[str, Any]:
    return {"hash": config.hash, "tickers": config.ticker_list_hash, "universe_version": config.universe.version, "seed": config.base.seed}


def of_machine() -> dict[str, Any]:
    node = platform.uname()
    return {"python": platform.python_version(), "system": f"{node.system} {node.release}", "host": node.node, "user": getpass.getuser(), "cores": os.cpu_count()}


def describe(spark: SparkSession | None = None, config: Config | None = None) -> dict[str, Any]:
    """A document of all probes. Its run is named by the time and, if known, the configuration."""
    probes: dict[str, Callable[[], Any]] = {"code": of_code, "packages": of_packages, "machine": of_machine}
    if spark is not None:
        probes["session"] = lambda: of_session(spark)
    if config is not None:
        probes["configuration"] = lambda: of_configuration(config)
    found: dict[str, Any] = {}
    for heading, probe in probes.items():
        try:
            found[heading] = probe()
        except Exception as error:  # a missing tool or user must not stop a run
            found[heading] = {"error": f"{type(error).__name__}: {error}"}
    now = datetime.now(UTC)
    tail = "" if config is None else f"-{config.hash}"
    return {"run": f"{now:%Y%m%dT%H%M%S}{tail}", "at": now.isoformat(timespec="milliseconds"), **found}


def keep(document: Mapping[str, Any], path: Path | None = None) -> Path:
    """Write a document, by default under the reports folder and its run's name."""
    return write_json(dict(document), path or folder("reports") / "runs" / f"{document['run']}.json")


def log_to(name: str = "tidemark", level: str = "INFO", file: Path | None = None) -> logging.Logger:
    """A logger with one console handler and, on request, a rotating file; calling again adds nothing."""
    log = logging.getLogger(name)
    log.setLevel(level.upper())
    have = {getattr(h, "_tidemark", None) for h in log.handlers}
    wanted: list[tuple[str, logging.Handler]] = [] if "console" in have else [("console", logging.StreamHandler())]
    if file is not None and str(file) not in have:
        file.parent.mkdir(parents=True, exist_ok=True)
        wanted.append((str(file), logging.handlers.RotatingFileHandler(file, maxBytes=5_000_000, backupCount=3, encoding="utf-8")))
    for mark, handler in wanted:
        handler._tidemark = mark
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    return log


def undecided(section: Mapping[str, Any], at: str = "") -> list[str]:
    """Dotted names of the configuration's parts that are marked as not decided yet."""
    here = [at] if section.get("decided") is False else []
    return here + [x for key, part in section.items() if isinstance(part, Mapping) for x in undecided(part, f"{at}.{key}".lstrip("."))]


def health(config: Mapping[str, Any] | None = None) -> list[tuple[str, bool, str]]:
    """(what, ok, detail): Python, the packages that the engine needs, and decisions still pending."""
    rows = [("python", tuple(map(int, platform.python_version_tuple()[:2])) >= (3, 11), platform.python_version())]
    rows += [(name, version is not None, version or "not installed") for name, version in of_packages().items()]
    return rows + [(part, False, "not decided") for part in undecided(config or {})]
