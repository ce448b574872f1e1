"""Structured Streaming form of the additive pass counter (see ``live``)."""
