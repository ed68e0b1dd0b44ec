"""The same computations over streams."""
