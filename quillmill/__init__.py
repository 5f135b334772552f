"""Analytics over bibliographic records, and corpus operators, as Spark plans."""
