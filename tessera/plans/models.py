"""Which models a request may name: providers with their aliases, configured models, vector dimensions."""

from __future__ import annotations

from typing import Any

from tessera.errors import TesseraError
from tessera.operators.search import MAX_DIMENSIONS

#: Short names of providers, and the providers of each kind of model.
ALIASES = {"ds": "deepseek", "gemini": "google"}
PROVIDERS = {"llm": ("deepseek", "openai"), "embedding": ("google", "siliconflow")}
MAX_MODEL = 256


def configured_models(configuration: dict[str, dict[str, dict[str, Any]]]) -> dict[str, list[dict[str, str]]]:
    """For each kind the (provider, model) pairs that have credentials and a model's name. ``configuration``:
    kind to provider to {"model": ..., "available": ...}."""
    return {
        kind: [{"provider": name, "model": entry["model"].strip()} for name, entry in providers.items() if entry.get("available") and (entry.get("model") or "").strip()]
        for kind, providers in configuration.items()
    }


def selected_model(kind: str, given: dict[str, Any], configuration: dict[str, dict[str, dict[str, Any]]] | None = None) -> dict[str, Any]:
    """A request's choice (provider, model and, for embeddings, dimensions; nothing else) with the provider's
    full name, and the configured model where it names none."""
    provider = ALIASES.get(given.get("provider"), given.get("provider"))
    model, dimensions = given.get("model"), given.get("dimensions")
    allowed = {"provider", "model", "dimensions"} if kind == "embedding" else {"provider", "model"}
    if set(given) - allowed or provider not in PROVIDERS[kind]:
        raise TesseraError("INVALID_INPUT", f"{kind} provider")
    if model is not None and (not isinstance(model, str) or not model.strip() or len(model) > MAX_MODEL):
        raise TesseraError("INVALID_INPUT", f"{kind} model")
    if dimensions is not None and (type(dimensions) is not int or not 1 <= dimensions <= MAX_DIMENSIONS):
        raise TesseraError("INVALID_INPUT", "dimensions")
    model = model or ((configuration or {}).get(kind, {}).get(provider, {}).get("model") or "")
    if not model.strip():
        raise TesseraError("INVALID_OPTIONS", f"{kind} model")
    return {"provider": provider, "model": model.strip()} | ({} if dimensions is None else {"dimensions": dimensions})


def has_dimensions(provider: str, model: str) -> bool:
    """Whether a model's vectors come in the length that is asked for."""
    return provider == "google" or provider == "siliconflow" and model.startswith("Qwen/Qwen3-")


def resolved_dimensions(selection: dict[str, Any], stored: int | None = None) -> int | None:
    """The length to ask for: the one given or, for a model that can choose, that of the stored vectors."""
    return selection.get("dimensions") or (stored if has_dimensions(selection["provider"], selection["model"]) else None)
