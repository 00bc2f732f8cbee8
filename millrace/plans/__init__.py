"""Queries bound to the tables of an input folder; importing this registers them."""

from . import base, extra, more, pages, search, web  # noqa: F401
