"""Causal views over the driver tables and the registry of named queries."""

import importlib

MODULES = ["q_did", "q_profile", "q_clean", "q_panel", "q_observational", "q_quasi"]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
