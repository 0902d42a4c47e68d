"""Column expressions: text cleaning, title rules, n-gram terms, vector maths."""
