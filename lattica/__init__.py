"""Analytics over unbalanced time x asset panels, as PySpark DataFrame plans."""
