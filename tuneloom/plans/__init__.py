"""Registered queries by area."""

from tuneloom.plans import compare, ensembles, evaluation, history, learning, racing, streams, structures, tuning  # noqa: F401
from tuneloom.plans.registry import REGISTRY  # noqa: F401
