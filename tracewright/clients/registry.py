"""Model providers by name. A client factory is called once per Spark task and gives the function that answers rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from tracewright.clients.http import RestClient, RestGenerator, RestJudge
from tracewright.clients.local import LocalGenerator, LocalJudge
from tracewright.functions.wire import DECISION_SCHEMA
from tracewright.sources.prompts import prompt_template

# --- fixed values: provider names of the settings, where the REST service is and where its key stands ---
REST_URL = "https://generativelanguage.googleapis.com/v1beta/models"
REST_KEY = "GEMINI_API_KEY"
REST_GENERATOR, REST_JUDGE = "gemini", "gemini-json"
LOCAL_GENERATOR, LOCAL_JUDGE = "transformers", "transformers-json"


@dataclass
class Role:
    """The providers of one role and the one that is meant where the settings name none."""

    name: str
    default: str
    makers: dict[str, Callable[..., Any]] = field(default_factory=dict)

    def make(self, config: Mapping[str, Any], *more: Any) -> Any:
        provider = config.get("provider", self.default)
        try:
            maker = self.makers[provider]
        except KeyError:
            raise ValueError(f"{self.name} has no provider {provider!r}; there are {', '.join(sorted(self.makers))}") from None
        return maker(config, *more)


def _rest(config: Mapping[str, Any], settings: Mapping[str, Any]) -> RestClient:
    return RestClient(str(config["model_id"]), str(config.get("base_url", REST_URL)), dict(settings), str(config.get("api_key_env", REST_KEY)))


def _rest_judge(config: Mapping[str, Any], pruning: Mapping[str, Any], template: str) -> RestJudge:
    asked = {**pruning, "response_mime_type": "application/json", "response_json_schema": DECISION_SCHEMA}
    return RestJudge(_rest(config, asked), template, str(config["prompt_version"]))


GENERATORS = Role("generator", LOCAL_GENERATOR, {
    REST_GENERATOR: lambda config, generation, most: RestGenerator(_rest(config, generation)),
    LOCAL_GENERATOR: lambda config, generation, most: LocalGenerator(str(config["model_id"]), config.get("revision"), dict(generation), most),
})
JUDGES = Role("judge", LOCAL_JUDGE, {
    REST_JUDGE: _rest_judge,
    LOCAL_JUDGE: lambda config, pruning, template: LocalJudge(str(config["model_id"]), config.get("revision"), pruning.get("generation", {}), template, str(config["prompt_version"])),
})


def generator_from(config: Mapping[str, Any], generation: Mapping[str, Any], max_units: int = 2) -> Any:
    return GENERATORS.make(config, generation, max_units)


def judge_from(config: Mapping[str, Any], pruning: Mapping[str, Any], prompts_dir: str = "prompts") -> Any:
    if "prompt_version" not in config:
        raise ValueError("the judge's config must name a prompt_version")
    return JUDGES.make(config, pruning, prompt_template(config["prompt_version"], prompts_dir))
