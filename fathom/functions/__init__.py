"""Part of the fathom retrieval and ranking engine."""
