"""Imports every module that registers queries."""

from faultline.plans import commits, evaluation, features, folds, history, modelling, snapshot_table, snapshots, sources, streams, tables  # noqa: F401
from faultline.plans.registry import ORACLES, QUERIES  # noqa: F401
