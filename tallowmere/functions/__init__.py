"""Column functions: narration, money, calendar."""
