"""kinsight: duplicate analytics over large catalogs, expressed as Spark plans."""

__all__ = ["session"]
