"""Block means over a stream of frames."""
