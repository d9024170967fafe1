"""Literature-corpus building and hybrid retrieval as Spark DataFrame jobs."""

from citeloom.config import Settings

__all__ = ["Settings"]
