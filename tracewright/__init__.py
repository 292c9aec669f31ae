"""Spark-native engine for reasoning-transition data sets.

Sub-packages: ``functions`` (column expressions), ``operators`` (row builders and
checks), ``sources``, ``sinks``, ``plans`` (replay and live construction loops),
``clients`` (pluggable generator and judge models), ``streaming``.
"""

from tracewright.plans.config import BuildConfig, TrainConfig, load_build_config, load_train_config
from tracewright.runtime import checkpointed, session

__all__ = ["BuildConfig", "TrainConfig", "checkpointed", "load_build_config", "load_train_config", "session"]
