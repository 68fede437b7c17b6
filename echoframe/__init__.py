"""echoframe: text/vector roundtrip datasets built and scored as Spark jobs."""

__version__ = "0.1.0"
