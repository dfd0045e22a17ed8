"""Views and queries; importing the package registers the queries of every module."""

from . import follow_up, generation  # noqa: F401
