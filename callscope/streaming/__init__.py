"""Live forms of the stateful operators."""
