"""arbor: tree ensembles, their metrics and text features as DataFrame plans."""
