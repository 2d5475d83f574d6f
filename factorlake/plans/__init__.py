"""Feature families and the factor pipeline."""
