"""Functions of the engine, as Column expressions."""
