"""wavefold: wave-packet analytics as Spark DataFrame plans."""
