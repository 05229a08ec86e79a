"""Part of the phrasemine engine."""
