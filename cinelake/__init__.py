"""Analytics over a media library, expressed as PySpark DataFrame operators."""
