"""Settings: built-in defaults, a file, and a user's own, merged and turned into ``Options`` on the driver."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from ..operators.contextual import FIRST_NAMES
from ..operators.detect import EXCLUDED, RULES, Custom, Rule
from ..operators.resolve import policy
from ..operators.validate import REVIEW_WORDS
from .redaction import STRATEGIES, Options

# The settings that may be given, and their defaults.
KEYS = ("policy_id", "policy_version", "entity_types", "default_strategy", "patterns", "patterns_mode", "name_redaction", "exclude_patterns", "exclude_patterns_mode", "human_review_keywords", "custom_names", "token_format", "limits", "policy", "llm")
DEFAULTS: dict[str, Any] = {
    "policy_id": "legal_tr_v1", "policy_version": "1.0.4", "policy": "balanced", "token_format": "namespaced", "default_strategy": "tag",
    "patterns": [], "exclude_patterns": list(EXCLUDED), "name_redaction": {"enabled": True, "gazetteer": True, "custom_names": []}, "human_review_keywords": list(REVIEW_WORDS), "llm": {},
}
TOKEN_FORMATS = ("namespaced", "legacy")


def read(spark: SparkSession, path: str) -> dict[str, Any]:
    """The settings of a JSON file at any path that Spark reads."""
    whole = spark.read.text(path, wholetext=True).first()
    found = json.loads(whole[0]) if whole else {}
    if not isinstance(found, dict):
        raise ValueError("settings must be a JSON object")
    return found


def read_names(spark: SparkSession, path: str, most: int = 200_000) -> frozenset[str]:
    """A dictionary of first names, one a line; at most ``most``, since it goes to every task."""
    rows = spark.read.text(path).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary holds at most {most} names")
    return frozenset(name for r in rows if (name := r[0].strip().lower()) and not name.startswith("#"))


def merged(base: dict[str, Any], own: dict[str, Any], strict: bool = True) -> dict[str, Any]:
    """``own`` over ``base``. Lists of patterns join by their mode, names and model settings key by key, all else replaces."""
    if strict and (unknown := sorted(set(own) - set(KEYS))):
        raise ValueError(f"unknown settings: {unknown}")
    out = {**base, **{k: v for k, v in own.items() if k not in ("patterns", "exclude_patterns", "name_redaction", "llm")}}
    if isinstance(given := own.get("patterns"), list):
        had, mode = base.get("patterns", []), own.get("patterns_mode", "append")
        out["patterns"] = given if mode == "replace" else given + had if mode == "prepend" else had + given
    if isinstance(given := own.get("exclude_patterns"), list):
        had = base.get("exclude_patterns", [])
        out["exclude_patterns"] = given if own.get("exclude_patterns_mode") == "replace" else list(dict.fromkeys(had + given))
    if isinstance(given := own.get("name_redaction"), dict):
        out["name_redaction"] = {**base.get("name_redaction", {}), **given}
    if "llm" in own:
        if not isinstance(own["llm"], dict):
            raise ValueError("llm must be an object")
        had = base.get("llm", {})
        out["llm"] = {**had, **own["llm"]} | {k: {**had.get(k, {}), **own["llm"].get(k, {})} for k in ("options", "headers") if k in had or k in own["llm"]}
    return out


def options(settings: dict[str, Any], first_names: frozenset[str] = FIRST_NAMES, **call: Any) -> Options:
    """Options of merged settings; what the call names goes before the settings, these before the defaults."""
    s = {**DEFAULTS, **settings}
    if s["token_format"] not in TOKEN_FORMATS or s["default_strategy"] not in STRATEGIES:
        raise ValueError("unknown token format or strategy")
    policy(s["policy"])
    own = tuple(Custom(p["id"], p["entity_type"], p["regex"], p.get("validator"), p.get("priority", 50)) for p in s["patterns"])
    names = s["name_redaction"]
    extra = frozenset(n.lower() for n in (*names.get("custom_names", ()), *s.get("custom_names", ())))
    found = {
        "policy": s["policy"], "strategy": s["default_strategy"], "custom": own, "names": names.get("enabled", True), "dictionary": names.get("gazetteer", True),
        "first_names": first_names | extra, "excluded": tuple(s["exclude_patterns"]), "rules": built_in(s),
    }
    return Options(**{**found, **call})


def built_in(settings: dict[str, Any]) -> tuple[Rule, ...]:
    """The built-in rules, unless patterns replace them."""
    return () if settings.get("patterns_mode") == "replace" else RULES
