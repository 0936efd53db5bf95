"""Column expressions: slope mechanics, triggers, scores, names and distances."""
