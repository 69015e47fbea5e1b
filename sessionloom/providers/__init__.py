"""Language models behind one call: prompts in, replies out."""

from .base import ContextOverflow, Provider, Reply, RuleProvider
from .calls import call_model

__all__ = ["ContextOverflow", "Provider", "Reply", "RuleProvider", "call_model"]
