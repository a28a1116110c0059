"""Structured Streaming twins of the conversation and retrieval operators."""
