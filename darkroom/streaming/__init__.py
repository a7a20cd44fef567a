"""Rules over streams of events. Each works on a batch table as well, with equal results."""
