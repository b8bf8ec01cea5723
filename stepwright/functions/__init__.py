"""Column functions: text, steps, tokens and numbers; built-in expressions only."""
