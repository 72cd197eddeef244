"""Column expressions: small linear algebra and distribution functions."""
