"""Imports every query module once, so that the registry is complete."""

from __future__ import annotations

import importlib

MODULES = ["q_core", "q_scalars", "q_clean", "q_features", "q_graphs", "q_forecast", "q_anomaly", "q_match", "q_stream", "q_sources"]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"flowspark.plans.{m}")


load()
