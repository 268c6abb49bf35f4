"""The stream forms of bar building and of the stateful signal."""
