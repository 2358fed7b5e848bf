class GeoError(ValueError):
    """Bad data, or a conversion that a format cannot express."""
