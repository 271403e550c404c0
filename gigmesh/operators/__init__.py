"""DataFrame-to-DataFrame operators: filters, joins, entity resolution, windows."""
