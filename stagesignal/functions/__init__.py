"""Part of the stagesignal library."""
