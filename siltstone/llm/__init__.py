"""Llm of the engine."""
