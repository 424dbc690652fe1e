"""Inputs: statement layouts, the event log, and ledger views of the test tables."""
