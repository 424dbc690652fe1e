"""A ledger analytics engine as DataFrame transformations, with operators for training data beside it."""
