"""Model clients: adapters for three services over plain HTTP, and scripted ones for tests."""

from .base import AnthropicClient, BatchCapableLLMClient, EchoClient, GoogleClient, LLMClient, OpenAIClient, ScriptedClient, is_batch_capable

__all__ = ["AnthropicClient", "BatchCapableLLMClient", "EchoClient", "GoogleClient", "LLMClient", "OpenAIClient", "ScriptedClient", "is_batch_capable"]
