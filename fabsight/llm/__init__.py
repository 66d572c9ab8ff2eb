"""Training-data operators: packing, chat formatting, filters, near-duplicates, search and scoring."""
