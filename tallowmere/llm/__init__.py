"""Training-data operators: tokenising, filtering, joining, searching and packing a corpus."""
