"""Run settings: YAML files with environment overrides, validated on the driver."""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

import yaml


@dataclass(frozen=True)
class BuildConfig:
    # --- fixed values: field names and defaults of the settings files ---
    round_id: str
    source_dataset: str
    hub_dataset_id: str
    generator: dict[str, Any]
    decision: dict[str, Any]
    source_type: str = "local_file"
    source_dataset_revision: str | None = None
    source_questions_path: str | None = None
    source_subset: str | None = None
    source_split: str = "train"
    source_question_field: str = "question"
    source_limit: int | None = None
    code_version: str | None = None
    private: bool = False
    generation: dict[str, Any] = field(default_factory=dict)
    pruning: dict[str, Any] = field(default_factory=dict)
    max_pruning_depth: int = 1
    max_examples_per_question: int = 1
    unit_split_strategy: str = "numbered_or_lines"
    max_retries_per_depth: int = 2
    max_units_per_batch: int = 2
    # --- settings of this engine ---
    parallel_tasks: int | None = None  # tasks that call models at the same time; none: as many as the session has shuffle partitions
    calls_per_task: int = 8  # calls a task has under way, where its client allows it

    def __post_init__(self) -> None:
        for name, least in {"max_retries_per_depth": 1, "max_units_per_batch": 2, "parallel_tasks": 1, "calls_per_task": 1}.items():
            if getattr(self, name) is not None and getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if self.max_units_per_batch < 3:
            warnings.warn("an attempt needs three units, so max_units_per_batch < 3 gives no rows", stacklevel=3)

    @property
    def depths(self) -> int:
        """Depths that can give a row; each gives at most one."""
        return max(0, min(self.max_pruning_depth, self.max_examples_per_question))


@dataclass(frozen=True)
class TrainConfig:
    # --- fixed values: field names and defaults of the settings files ---
    base_model: str
    hub_model_id: str
    hub_dataset_id: str
    max_steps: int = 3
    learning_rate: float = 1e-4
    per_device_train_batch_size: int = 1
    gradient_accumulation_steps: int = 1
    max_length: int | None = None
    report_to: list[str] = field(default_factory=lambda: ["wandb"])
    project: str = "tracewright"
    run_name: str = "smoke"

    def __post_init__(self) -> None:
        if isinstance(self.report_to, str):
            object.__setattr__(self, "report_to", [self.report_to])
        elif not isinstance(self.report_to, list) or not all(isinstance(x, str) for x in self.report_to):
            raise ValueError("report_to must be a string or list of strings")


#: Types a field is read as; None stays None only for optional ones.
_READ = {"str": str, "int": int, "float": float, "bool": bool, "str | None": str, "int | None": int, "dict[str, Any]": dict}


def _from_mapping(kind: type, raw: Mapping[str, Any], required: tuple[str, ...]) -> Any:
    """Falsy required fields count as missing; mappings must be mappings, null ones too."""
    for name in required:
        if not raw.get(name):
            raise ValueError(f"missing required config field: {name}")
    values: dict[str, Any] = {}
    for f in fields(kind):
        if f.name not in raw:
            continue
        value, as_type = raw[f.name], _READ.get(str(f.type))
        if as_type is dict:
            if not isinstance(value, Mapping):
                raise ValueError(f"{f.name} must be a mapping")
            value = dict(value)
        elif as_type and not (value is None and "None" in str(f.type)):
            value = as_type(value)
        values[f.name] = value
    return kind(**values)


#: Settings for a run without a settings file: each must come from the environment where it matters.
FALLBACK = {
    "round_id": "local", "source_dataset": "-", "hub_dataset_id": "out", "generator": {"model_id": "-"}, "decision": {"model_id": "-"},
    "source_questions_path": "questions.txt", "max_units_per_batch": 6,
}


def _yaml(path: str | Path) -> dict[str, Any]:
    return yaml.safe_load(Path(path).read_text()) or {}


def load_build_config(path: str | Path) -> BuildConfig:
    return build_config(_yaml(path))


def build_config_or(path: str | Path | None, default: Mapping[str, Any], environment: Mapping[str, str] | None = None) -> BuildConfig:
    """The file's settings, or ``default`` where there is no such file, with environment overrides."""
    raw = _yaml(path) if path and Path(path).exists() else default
    return override_from_environment(build_config(raw), environment)


def build_config(raw: Mapping[str, Any]) -> BuildConfig:
    config = _from_mapping(BuildConfig, raw, ("round_id", "source_dataset", "hub_dataset_id"))
    for name in ("generator", "decision"):
        if not getattr(config, name).get("model_id"):
            raise ValueError(f"missing required config field: {name}.model_id")
    return config


def load_train_config(path: str | Path, environment: Mapping[str, str] | None = None) -> TrainConfig:
    """The file's settings; a field's upper-case name in ``environment`` (``WANDB_PROJECT`` for the project) wins over the file."""
    raw = dict(_yaml(path))
    names = {"project": "WANDB_PROJECT"}
    for f in fields(TrainConfig):
        if (given := (environment or {}).get(names.get(f.name, f.name.upper()))) is not None:
            raw[f.name] = [x.strip() for x in given.split(",") if x.strip()] if f.name == "report_to" else given
    return _from_mapping(TrainConfig, raw, ("base_model", "hub_model_id", "hub_dataset_id"))


def override_from_environment(config: BuildConfig, environment: Mapping[str, str] | None = None) -> BuildConfig:
    """Scalar settings by their upper-case names; models and sampling by four names of their own.

    Whether an empty value counts differs by name: empty numbers of SOURCE_LIMIT and the four are ignored, an empty
    SOURCE_SUBSET clears the subset, any PRIVATE but ``false`` is private."""
    env = os.environ if environment is None else environment
    changes: dict[str, Any] = {}
    for name in ("round_id", "source_type", "source_dataset", "source_dataset_revision", "source_split", "source_question_field", "hub_dataset_id"):
        if name.upper() in env:
            changes[name] = env[name.upper()]
    for name in ("max_pruning_depth", "max_examples_per_question", "max_retries_per_depth", "max_units_per_batch", "parallel_tasks", "calls_per_task"):
        if name.upper() in env:
            changes[name] = int(env[name.upper()])
    if "SOURCE_SUBSET" in env:
        changes["source_subset"] = env["SOURCE_SUBSET"] or None
    if env.get("SOURCE_LIMIT"):
        changes["source_limit"] = int(env["SOURCE_LIMIT"])
    if "PRIVATE" in env:
        changes["private"] = env["PRIVATE"].lower() != "false"
    nested = {"GENERATOR_MODEL": ("generator", "model_id", str), "DECISION_MODEL": ("decision", "model_id", str), "MAX_NEW_TOKENS": ("generation", "max_new_tokens", int), "GENERATION_TEMPERATURE": ("generation", "temperature", float)}
    for name, (group, key, kind) in nested.items():
        if env.get(name):
            changes[group] = {**changes.get(group, getattr(config, group)), key: kind(env[name])}
    return replace(config, **changes)


#: A setting of an environment file: a name, perhaps exported, and a value in double quotes (with escapes), in single quotes, or bare.
_SETTING = re.compile(
    r"""^\s*(?:export\s+)?(?P<name>[^\s=#'"]+)\s*=\s*(?:"(?P<escaped>(?:[^"\\]|\\.)*)"\s*(?:\#.*)?|'(?P<literal>[^']*)'\s*(?:\#.*)?|(?P<bare>.*?))\s*$""",
    re.VERBOSE,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def load_env_file(path: str | Path, environment: dict[str, str] | None = None) -> None:
    """Settings of an environment file that aren't set yet; a file that isn't there has none.

    Lines that set nothing are passed over. Behind a quoted value there may be a comment; a bare value goes to the end of its line."""
    env = os.environ if environment is None else environment
    if not Path(path).is_file():
        return
    for found in filter(None, map(_SETTING.match, Path(path).read_text().splitlines())):
        value = next(x for x in (found["literal"], found["bare"], found["escaped"]) if x is not None)
        if found["escaped"] is not None:
            value = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value)
        if found["name"] not in env:
            env[found["name"]] = value
