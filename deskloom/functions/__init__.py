"""Column functions: text, rules, scores. No shuffles, no actions."""
