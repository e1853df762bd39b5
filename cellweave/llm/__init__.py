"""Training-data operators: packing, deduplication, extraction, filtering and storage of text at corpus scale."""
