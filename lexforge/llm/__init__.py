"""Training-data operators: filters, dedup joins, mixing, extraction and formatting at corpus scale."""
