"""Settings from a YAML or JSON file."""

from __future__ import annotations

import json
import os

from .schemas import Settings

NAMES = ["costlens.yaml", "costlens.yml", "costlens.json"]
_KNOWN = {
    "": {"version", "provider", "models", "quality_threshold", "min_pass_rate", "pricing", "volume", "scan"},
    "provider": {"base_url", "api_key_env", "judge_url", "judge_key_env"},
    "models": {"baseline", "candidates", "judge"},
    "volume": {"default_per_day", "per_call_site"},
    "scan": {"include", "exclude"},
}


class ConfigError(ValueError):
    """A settings file is wrong; the message lists everything that is."""


def _is_number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _is_texts(x) -> bool:
    return isinstance(x, list) and all(isinstance(v, str) and v.strip() for v in x)


def parse(data: dict) -> Settings:
    """Settings of a parsed file; all problems, wrong types among them, are found before any is raised. Nothing at all gives the defaults, which name no model."""
    if not isinstance(data, dict):
        raise ConfigError("settings must be a mapping")
    problems = [f"unknown field {k}" for k in data if k not in _KNOWN[""]]
    if data.get("version", 1) != 1:
        problems.append(f"version must be 1, got {data['version']}")
    part = {}
    for name in ("provider", "models", "volume", "scan", "pricing"):
        part[name] = {} if data.get(name) is None else data[name]
        if not isinstance(part[name], dict):
            problems.append(f"{name} must be a mapping")
            part[name] = {}
        problems += [f"unknown field {name}.{k}" for k in part[name] if name in _KNOWN and k not in _KNOWN[name]]

    def take(section: str, key: str, default, good, kind: str):
        value = part[section].get(key) if section else data.get(key)
        if value is None or good(value):
            return default if value is None else value
        problems.append(f"{section}{'.' if section else ''}{key} must be {kind}, got {value!r}")
        return default

    text = lambda x: isinstance(x, str) and bool(x.strip())
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    prices = {}
    for model, price in part["pricing"].items():
        if not isinstance(price, dict) or not all(_is_number(price.get(k)) and price[k] >= 0 for k in ("input", "output")):
            problems.append(f"pricing.{model} needs input and output numbers of 0 or more")
        else:
            problems += [f"unknown field pricing.{model}.{k}" for k in price if k not in ("input", "output", "tier")]
            prices[model] = (float(price["input"]), float(price["output"]))
    volumes = take("volume", "per_call_site", {}, lambda x: isinstance(x, dict) and all(whole(v) for v in x.values()), "whole numbers of 0 or more by call site")
    baseline = take("models", "baseline", "", text, "a non-empty string")
    out = Settings(
        baseline=baseline,
        candidates=take("models", "candidates", [], _is_texts, "a list of non-empty strings"),
        prices=prices,
        threshold=take("", "quality_threshold", 0.95, _is_number, "a number"),
        floor=take("", "min_pass_rate", 0.0, _is_number, "a number"),
        default_volume=take("volume", "default_per_day", 1000, whole, "a whole number of 0 or more"),
        volumes=dict(volumes),
        judge=take("models", "judge", None, text, "a non-empty string") or baseline or None,
        base_url=take("provider", "base_url", "http://localhost:11434/v1", text, "a non-empty string"),
        api_key_env=take("provider", "api_key_env", None, text, "a non-empty string"),
        judge_url=take("provider", "judge_url", None, text, "a non-empty string"),
        judge_key_env=take("provider", "judge_key_env", None, text, "a non-empty string"),
        include=take("scan", "include", ["*.py"], _is_texts, "a list of non-empty strings"),
        exclude=take("scan", "exclude", [], _is_texts, "a list of non-empty strings"),
    )
    if problems := problems + (out.problems() if data else []):
        raise ConfigError("; ".join(problems))
    return out


def load(path: str) -> Settings:
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        return parse(json.loads(text))
    try:
        import yaml
    except ImportError:
        raise ConfigError("reading YAML needs the yaml package; use JSON instead") from None
    return parse(yaml.safe_load(text) or {})


def find(explicit: str | None, beside: str) -> str | None:
    """The named file, else one of the usual names in the folder ``beside``."""
    if explicit:
        return explicit
    return next((p for p in (os.path.join(beside, n) for n in NAMES) if os.path.isfile(p)), None)
