"""turnloom: prompt/response turn analytics over append-only session logs, on Spark."""

from turnloom.session import configure, shared_dir

__all__ = ["configure", "shared_dir"]
