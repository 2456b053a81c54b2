"""Plans: the domain's views over the driver's tables, serving queries and the batch run."""
