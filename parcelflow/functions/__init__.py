from parcelflow.functions import geometry, scalars  # noqa: F401
