"""Importing this module fills the registry with all indicators."""

from . import lags, pointwise, recursive, windows  # noqa: F401
from .registry import REGISTRY, compute, find_indicator, indicator_count, warm_up  # noqa: F401
