"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

from tapewarden.operators.split import CLEANUP, written

__all__ = ["CLEANUP", "written"]
