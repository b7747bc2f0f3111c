"""DataFrame operators: order, windows, statistics, preparation, models, joins."""
