"""Column functions: bounds, scores, deterministic uniforms, text and number formats."""
