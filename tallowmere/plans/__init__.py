"""The registry of ledger queries and their SQL oracles."""
