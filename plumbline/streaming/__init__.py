"""No streaming operators: the work this library covers is batch only."""
