"""Table-to-table operators over a Dataset."""
