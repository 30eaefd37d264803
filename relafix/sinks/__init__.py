"""Writers of findings and facts."""
