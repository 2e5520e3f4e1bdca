"""DataFrame-to-DataFrame building blocks of the cohort plans."""
