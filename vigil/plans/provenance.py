"""Where a result comes from: commits, run and versions."""

from __future__ import annotations

import datetime
import platform
import subprocess


def git(*args: str, folder: str = ".") -> str:
    """Output of a git command, or nothing where there is no repository."""
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=False)
    return done.stdout.strip() if done.returncode == 0 else ""


def run_id(now: datetime.datetime | None = None) -> str:
    return (now or datetime.datetime.now(datetime.UTC)).strftime("%Y%m%dT%H%M%SZ")


def provenance(mode: str, *, freeze_tag: str = "", folder: str = ".", extra: dict[str, str] | None = None) -> dict[str, str]:
    import numpy
    import pyspark

    versions = {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__}
    commits = {"protocol_freeze_commit": git("rev-list", "-n1", freeze_tag, folder=folder) if freeze_tag else "", "analysis_commit": git("rev-parse", "HEAD", folder=folder)}
    return {"mode": mode, "run_id": run_id(), **commits, **versions, **(extra or {})}
