"""Training-data operators: token counts, decontamination, fingerprints, joins, models, dedup, chat."""
