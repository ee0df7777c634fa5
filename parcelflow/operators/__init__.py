from parcelflow.operators import aggregates, joins, percentiles, profiles, spatial, windows  # noqa: F401
