"""Training-data operators: packing, archives, near duplicates, sharding, decontamination, licences, language."""
