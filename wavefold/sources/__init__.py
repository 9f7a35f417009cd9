"""Fields and catalogues: where tables come from and go to."""
