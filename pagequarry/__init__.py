"""Analytics over catalogues of code examples and documentation trees, declared as Spark DataFrame plans."""
