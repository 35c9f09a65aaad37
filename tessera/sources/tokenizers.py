"""Token counters by name: the estimate, characters, or a tokenizer file."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from tessera.operators.chunking import estimate_tokens


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def counter(path: str) -> Callable[[str], int]:
    """Counts ids with the special ones, by a tokenizer file that each worker loads once."""

    def count(text: str) -> int:
        return len(_tokenizer(path).encode(text).ids)

    return count


def counters(models: dict[str, str]) -> dict[str, Callable[[str], int]]:
    """Counters of a registry {model: path}; a model that isn't in it raises KeyError when looked up."""
    return {model: counter(path) for model, path in models.items()}


BUILTIN: dict[str, Callable[[str], int]] = {"estimate": estimate_tokens, "characters": len}
