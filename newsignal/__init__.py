"""News text and daily prices to labelled events, trading signals and performance reports, on Spark."""

__version__ = "0.1.0"
