"""Column builders: vectors, text, priors, log-space maths, hash-seeded draws."""
