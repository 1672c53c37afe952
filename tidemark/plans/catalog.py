"""All registered queries."""

from __future__ import annotations

from . import mail_queries, stream_queries, task_queries, walk_queries
from .registry import Registry

registry = Registry()
for part in (task_queries, mail_queries, stream_queries, walk_queries):
    registry.merge(part.registry)
