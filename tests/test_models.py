import pytest

from tessera.errors import TesseraError
from tessera.plans import models

CONFIGURED = {"llm": {"deepseek": {"model": " chat ", "available": True}, "openai": {"model": "", "available": True}}, "embedding": {"google": {"model": "vectors", "available": False}, "siliconflow": {"model": "bge", "available": True}}}


def test_configured_models_have_a_name_and_credentials():
    assert models.configured_models(CONFIGURED) == {"llm": [{"provider": "deepseek", "model": "chat"}], "embedding": [{"provider": "siliconflow", "model": "bge"}]}


def test_selection_resolves_aliases_and_defaults():
    assert models.selected_model("llm", {"provider": "ds"}, CONFIGURED) == {"provider": "deepseek", "model": "chat"}
    assert models.selected_model("embedding", {"provider": "gemini", "model": "m", "dimensions": 8}) == {"provider": "google", "model": "m", "dimensions": 8}


@pytest.mark.parametrize("kind, given", [("llm", {"provider": "gemini"}), ("llm", {}), ("llm", {"provider": "ds", "dimensions": 3}), ("embedding", {"provider": "google", "model": " "}), ("embedding", {"provider": "google", "model": "m", "dimensions": True}), ("embedding", {"provider": "google", "model": "m", "dimensions": 16001}), ("embedding", {"provider": "google", "model": "m", "key": "x"}), ("llm", {"provider": "openai"})])
def test_other_selections_are_refused(kind, given):
    with pytest.raises(TesseraError):
        models.selected_model(kind, given, CONFIGURED)


def test_dimensions():
    own = lambda p, m, **more: {"provider": p, "model": m} | more
    assert models.resolved_dimensions(own("google", "m"), 64) == 64
    assert models.resolved_dimensions(own("google", "m", dimensions=8), 64) == 8
    assert models.resolved_dimensions(own("siliconflow", "Qwen/Qwen3-Embedding"), 64) == 64
    assert models.resolved_dimensions(own("siliconflow", "bge"), 64) is None and models.resolved_dimensions(own("google", "m")) is None
