"""Registered queries: each operator over the given tables, with its SQL twin where there is one."""

from workloads import jobs, pages, replies, similarity, store, streams, text  # noqa: F401
from workloads.base import CASES

__all__ = ["CASES"]
