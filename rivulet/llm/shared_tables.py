"""Intermediate tables: see ``rivulet.shared``."""

from rivulet.shared import discard, folder, written

__all__ = ["discard", "folder", "written"]
