"""Matrix expressions, their rewrites, and the physical strategies that carry them out."""
