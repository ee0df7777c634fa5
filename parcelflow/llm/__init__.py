"""Operators that prepare text corpora for training: packing, decontamination, sharding, dedup, secrets, quality, archives, chat."""
