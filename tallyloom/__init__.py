"""Spark jobs for semi-structured tool output, source code, package metadata, session registries and build logs."""

from tallyloom.session import build_session, prepare

__all__ = ["build_session", "prepare"]
