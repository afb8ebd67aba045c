"""Column expressions: labels, responses, text features, probabilities, statistics."""
