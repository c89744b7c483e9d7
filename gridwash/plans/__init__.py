"""Steps, recipes, history and the operational reports."""
