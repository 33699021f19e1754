"""The engine as a stream."""
