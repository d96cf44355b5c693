"""Keyed session state over key events, in batch and as a stream, and running token counts."""
