"""Training-data operators: near and exact dedup, packing, scoring, scans, chat, language ID, BPE."""
