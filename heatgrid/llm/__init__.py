"""Training-data operators: token counts, decontamination, filters, deduplication and mixing."""
